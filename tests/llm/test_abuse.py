from __future__ import annotations

import random

from scriptloom.llm.abuse import fit, labelled_sample, rates_by_source, score_documents, sentences


def corpus(n, seed):
    rnd = random.Random(seed)
    calm = ["the scene at the {} was shot in one day", "i liked the {} and the light", "two readers would cut the {}", "the {} is back and the map is not"]
    rude = ["you are a worthless idiot and a moron", "shut your mouth you pathetic idiot", "what a stupid moron you are"]
    out = []
    for i in range(n):
        s = [rnd.choice(calm).format("".join(rnd.choices("abcdefg", k=6))) + "." for _ in range(6)]
        y = i % 4 == 0
        if y:
            s[rnd.randrange(6)] = rnd.choice(rude) + "!"
        out.append((" ".join(s), float(y)))
    return out


def test_disguises():
    plain = sentences("you idiot")[0]
    for t in ("You 1d10t", "you i​diot", "you idiiiot", "YOU ÍDIOT", "you i.d.i.o.t", "you іdіot"):
        assert sentences(t)[0] == plain, t
    assert sentences("") == [] and sentences("... !!! 12") == [("#",)]
    assert sentences("f**k it")[0][0] == "f*k"


def test_held_out_accuracy():
    model = fit(corpus(200, 1))
    test = corpus(200, 2)
    found = [model.score(t) >= model.threshold for t, _ in test]
    assert sum(f == (y > 0.5) for f, (_, y) in zip(found, test)) >= 190
    # an unseen misspelling
    assert model.score("you are a wortless idoit and a morron") > model.score("the scene at the harbour was shot in one day")
    assert model.score(None) == 0.0 and model.score("") == 0.0


def test_noise_and_missing_classes():
    noisy = [(t, 1 - y if i % 20 == 1 else y) for i, (t, y) in enumerate(corpus(300, 3))]
    model = fit(noisy)
    assert sum((model.score(t) >= model.threshold) == (y > 0.5) for t, y in corpus(100, 4)) >= 90
    assert fit([]).score("you idiot") < 0.5 and fit([("calm text", 0.0)]).score("you idiot") < 0.5


def test_frame(spark):
    docs = corpus(120, 5)
    rows = [(i, t, "Src " if i % 2 else "src") for i, (t, _) in enumerate(docs)] + [(900, None, None), (901, "", "src")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    votes = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(docs)] + [(5, None), (900, 1), (7777, 1)], "doc_id long, abusive int")
    taken, weight = labelled_sample(d, votes)
    assert len(taken) == 120 and weight == 1.0
    assert len(labelled_sample(d, votes, 10, 15)[0]) <= 25
    few = labelled_sample(d, votes, max_chars=2000)[0]
    assert 0 < sum(len(t) for t, _ in few) <= 2000 and all(t in {x for x, _ in docs} for t, _ in few)
    assert labelled_sample(d, votes, max_chars=10)[0] == []
    scored = score_documents(d, fit(taken, weight), "source")
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 122 and got[900]["score"] == 0 and not got[901]["abusive"]
    assert sum(got[i]["abusive"] == (y > 0.5) for i, (_, y) in enumerate(docs)) >= 115
    assert {r["source"] for r in rates_by_source(scored).collect()} == {"src", None}


def test_wrapped_lines():
    assert sentences("nobody asked for\nyour opinion.\nGo home\nLoser") == [("nobody", "asked", "for", "your", "opinion"), ("go", "home"), ("loser",)]
