from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm.leakage import ItemBlock, edit_distance, find_leaks, ids_of, passages, places, plan, signatures, stretches, walk, windows_within, words_of


def texts(n, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 8))) for _ in range(5000)]
    return [[rnd.choice(vocab) for _ in range(80)] for _ in range(n)], rnd, vocab


def test_words():
    assert words_of("<p>Don’t  STOP&nbsp;me&amp;you, café​-bar co-\n operate!</p>") == ["dont", "stop", "me", "you", "cafe", "bar", "cooperate"]
    assert words_of("") == []


def changed(words, kind, rnd, vocab, every=5):
    """Every fifth word replaced, dropped, or followed by an added one."""
    out = []
    for i, w in enumerate(words):
        if i % every != every // 2:
            out.append(w)
        elif kind != "dropped":
            out += [w, rnd.choice(vocab)] if kind == "added" else [rnd.choice(vocab)]
    return out


def test_candidates_reach_the_target():
    """One changed word in five, stretches of two fifths of an item: what verification accepts must be found."""
    items, rnd, vocab = texts(150)
    classes = plan(80, 0.4, 0.2, 0.97)
    _, window, stride, sampled, repetitions = next(c for c in reversed(classes) if c[0] <= 80)
    block = ItemBlock(dict(enumerate(items)), None, window, repetitions, sampled)
    for kind in ("replaced", "added", "dropped"):
        docs = [ids_of([rnd.choice(vocab) for _ in range(60)] + changed(w[20:52], kind, rnd, vocab) + [rnd.choice(vocab) for _ in range(60)]) for w in items]
        found = set(block.candidates(docs, walk(docs, window, stride, repetitions, sampled), 0.2))
        assert sum((i, i) in found for i in range(len(items))) >= 0.95 * len(items), kind
    docs = [ids_of(["lead", *w[30:48], "end"]) for w in items]
    found = set(block.candidates(docs, walk(docs, window, stride, repetitions, sampled), 0.2))
    assert all((i, i) in found for i in range(len(items)))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=14), st.integers(0, 6))
def test_edit_distance(a, b, most):
    assert edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most) == min(plain_distance(a, b), most + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=6, max_size=6), st.lists(st.integers(2, 4), min_size=6, max_size=6), st.integers(0, 3))
def test_windows(a, b, most):
    got = windows_within(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64), np.array([6]), np.array([6]), np.array([most]))[0]
    want = min([plain_distance(a, b[:j]) for j in range(7)] + [plain_distance(a[:i], b) for i in range(7)])
    assert got == (want <= most)


def test_signatures_do_not_depend_on_neighbours():
    ids = ids_of("a b c d e f g h i j k l m n o p q r s t u v".split())
    alone = signatures(ids[3:13], np.array([0]), 10, 4, 9, np.array([10]))
    among = signatures(ids, np.array([3]), 10, 4, 9, np.array([len(ids)]))
    assert (alone == among).all()


def held(item, doc):
    ids = ids_of(item)
    return stretches(ids, places(ids), ids_of(doc)).mean()


def test_stretches():
    items, rnd, vocab = texts(2, 5)
    a, other = items
    assert held(a, a) == 1.0
    assert held(a, other) < 0.1
    assert 0.4 <= held(a, other[:20] + a[10:46] + other[20:]) <= 0.5
    # sentences in another order, a word dropped, a word inserted
    assert held(a, a[40:] + ["xx"] + a[:40]) > 0.95
    assert held(a, a[:30] + a[31:]) > 0.9 and held(a, a[:30] + ["new"] + a[30:]) > 0.9


def test_too_many_changes_are_no_stretch():
    items, rnd, vocab = texts(30, 11)
    for w in items:
        for kind in ("replaced", "added", "dropped"):
            assert held(w, changed(w, kind, rnd, vocab, 5)) > 0.85
            assert held(w, changed(w, kind, rnd, vocab, 3)) == 0


def test_instruction_is_no_passage(spark):
    rows = [(i, f"Read the scene and decide. The {w} ran over the hill with a lamp.") for i, w in enumerate(["cat", "dog", "ox"])]
    df = spark.createDataFrame(rows + [(7, None), (None, "x"), (8, "")], "item_id long, text string")
    got = {r["item_id"]: r["words"] for r in passages(df).collect()}
    assert got[0][:2] == ["the", "cat"] and got[8] == [] and set(got) == {0, 1, 2, 8}
    assert passages(df.where("item_id < 1")).first()["words"][:2] == ["read", "the"]


def test_against_all_pairs(spark):
    """Every pair of a document and an item verified, beside what the hashes find; many blocks, one scan of the documents."""
    items, rnd, vocab = texts(60, 3)
    docs = []
    for i in range(240):
        a, b = items[rnd.randrange(60)], items[rnd.randrange(60)]
        kind = rnd.choice(["replaced", "added", "dropped"])
        docs.append(" ".join([rnd.choice(vocab) for _ in range(20)] + changed(a[: rnd.choice([10, 30, 36, 60])], kind, rnd, vocab, rnd.choice([5, 6, 9, 99])) + b[50 : rnd.choice([55, 80])]))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    true = set()
    own = [(k, ids_of(w), places(ids_of(w))) for k, w in enumerate(items)]
    for k, t in enumerate(docs):
        ids = ids_of(words_of(t))
        true |= {(k, n) for n, x, at in own if stretches(x, at, ids, np.ones(len(x), dtype=bool)).mean() >= 0.4}
    got = find_leaks(d, i, block_items=12, blocks_a_pass=5)
    found = {(r[0], r[1]) for r in got.collect()}
    assert len(true) > 100 and found <= true and len(found) >= 0.97 * len(true)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_frame_and_blocks(spark):
    items, rnd, vocab = texts(9, 7)
    rows = [(i, " ".join(w)) for i, w in enumerate(items)] + [(100, None), (101, ""), (None, "x y z"), (102, "ab cd")]
    docs = [(1, " ".join(items[0]).upper()), (2, " ".join(items[0])), (3, None), (4, ""), (5, "word"), (6, " ".join(items[3][:40] + items[5][:40])), (7, "z " * 30_000 + " ".join(items[8])), (8, "say ab cd now")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(rows, "item_id long, text string").unionByName(spark.createDataFrame([(0, " ".join(items[0]))], "item_id long, text string"))
    want = {(1, 0), (2, 0), (6, 3), (6, 5), (7, 8)}
    assert {(r[0], r[1]) for r in find_leaks(d, i).collect()} == want
    assert {(r[0], r[1]) for r in find_leaks(d, i, block_items=2, blocks_a_pass=2).collect()} == want
    assert {(r[0], r[1]) for r in find_leaks(d, i, block_words=100).collect()} == want
    assert find_leaks(d.where("doc_id > 99"), i).count() == 0
    assert find_leaks(d, i.where("item_id > 999")).count() == 0
