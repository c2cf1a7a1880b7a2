"""Problem 8: score every document for abusive, hateful or sexually explicit language.

Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy. A word is the bag of itself and its
character n-grams, so an unseen misspelling shares most vectors with the word it hides; a sentence is the mean of its words;
a softmax layer gives the probability that the sentence is abusive. A document scores as its worst sentence, so one insult
in a long text is not averaged away.

Labels are votes on documents, not on sentences. Training therefore alternates: all sentences of voted-abusive documents
start as abusive, each round keeps only those that a model trained without the document still holds for abusive, and voted-
abusive documents without any such sentence are left out of the next round, as raters err.

Before the n-grams, a text is freed from the usual disguises: invisible characters, look-alike letters of other alphabets,
digits and signs for letters, letters set apart, and repeated letters. Asterisks stay, as a masked word is known by them.

Scoring is one pass over all documents without a shuffle; the model (a few MB, of fixed size) goes to the workers as a
broadcast. Training reads at most `max_abusive` documents voted abusive and `max_others`
others, drawn by a hash of their id, of at most `max_chars` characters together.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters of the model: hash buckets, dimensions, n-gram lengths.
BUCKETS, DIM, NGRAMS = 1 << 18, 4, (3, 4, 5)
#: Bounds on the labelled documents used for training: voted abusive, and others.
MAX_ABUSIVE, MAX_OTHERS = 1500, 5000
#: Bound on the characters of their texts together; whole documents are left out beyond it.
MAX_CHARS = 40_000_000
#: Neutral words added to every sentence, so that the mean of one or two common words says little.
PAD = 2
#: Length of a training step over the whole table of embeddings.
STEP = 3.0
#: Weight of the abusive sentences against all others, and the share of sentences of harmless documents that count as usual.
POSITIVE, USUAL = 0.2, 0.98

# Look-alike letters of other alphabets, and signs that stand for letters.
LOOKALIKE = str.maketrans("аеосрхуіјѕԁһкмтвнοαερικνυτ", "aeocpxyijsdhkmtbhoaepiknut")
SIGNS = str.maketrans("013457@$€!|", "oieastaseil")

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+")
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·]{1,3}[^\W_](?![^\W_])){2,}")
_GAP = re.compile(r"([ .\-_*·]{1,3})")
_WRAPPED = re.compile(r"(?<=[^\s.!?…:])[ \t]*\n[ \t>]*(?=[^\W\d_A-ZÀ-Þ])")
_TOKEN = re.compile(r"[\w@$€!|*]+")
_MARKUP = re.compile(r"<[^<>]{0,200}>")
# invisible format characters, and accents that stand by themselves
_HIDDEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_ACCENT = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")
_TWICE = re.compile(r"(.)\1+")


@lru_cache(1 << 18)
def _plain(token: str) -> str:
    """A token in plain letters; '' if it holds none."""
    token = token.strip("!|")
    if not any(c.isalpha() for c in token):
        # a word may be written in signs alone; a number may not
        if not any(c in "@$€!|*" for c in token) or len(token) < 3:
            return "#" if token.isdigit() else ""
    if not token.isalpha():
        token = token.translate(SIGNS)
    return _TWICE.sub(r"\1", token)


def raw_sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lists of tokens, freed from markup, hidden characters, accents and letters set apart."""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "\n" in text:
        # a line that goes on in lower case was only wrapped
        text = _WRAPPED.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(LOOKALIKE)
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text))
    else:
        text = text.casefold()
    text = _APART.sub(lambda m: _GAP.sub(lambda g: " " if len(g[1]) > 1 else "", m[0]), text)
    return [_TOKEN.findall(s) for s in _SENTENCE.split(text)]


def sentences(text: str) -> list[tuple[str, ...]]:
    """The sentences of a text as tuples of plain words. Empty ones are left out."""
    return [words for s in raw_sentences(text) if (words := tuple(w for w in map(_plain, s) if w))]


def features(word: str, buckets: int) -> list[int]:
    """Hash buckets of a word and its character n-grams; masked words share one more."""
    marked = f"<{word}>"
    grams = {marked, "*"} if "*" in word else {marked}
    grams |= {marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)}
    return [xxhash.xxh32_intdigest(g) % buckets for g in sorted(grams)]


def _sums(values: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, one dimension after the other, which is several times faster than whole rows of few numbers."""
    return np.stack([np.add.reduceat(np.ascontiguousarray(values[:, k]).take(rows), starts) for k in range(values.shape[1])], axis=1)


class _Bag:
    """Rows that are means of other rows, with the transposed sums for the gradient."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, n_columns: int, pad: int = 0):
        self.sizes, self.columns, self.n_columns, self.pad = sizes, columns, n_columns, pad
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.scale = (1.0 / (sizes + pad)).astype(np.float32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(columns, kind="stable")
        self.back = owner[order]
        self.seen, self.back_starts = np.unique(columns[order], return_index=True)

    @classmethod
    def of(cls, rows: list[list[int]], n_columns: int, pad: int = 0) -> _Bag:
        return cls(np.array([len(r) for r in rows]), np.fromiter((c for r in rows for c in r), dtype=np.int64), n_columns, pad)

    def only(self, rows: np.ndarray, columns: np.ndarray | None = None) -> _Bag:
        """The rows of a mask; with `columns`, sorted and all that these rows have, by their places among them."""
        own = self.columns[np.repeat(rows, self.sizes)]
        return _Bag(self.sizes[rows], own if columns is None else np.searchsorted(columns, own), self.n_columns if columns is None else len(columns), self.pad)

    def mean(self, values: np.ndarray) -> np.ndarray:
        return _sums(values, self.columns, self.starts) * self.scale[:, None]

    def gradient(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_columns, rows.shape[1]), dtype=np.float32)
        out[self.seen] = _sums(rows * self.scale[:, None], self.back, self.back_starts)
        return out


class AbuseModel:
    """The fitted model. `threshold` is the score from which a document is reported."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, threshold: float = 0.5):
        self.embeddings, self.weights, self.bias, self.threshold = embeddings, weights, bias, threshold
        self._logit: dict[str, float] = {}
        self._token: dict[str, float | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_logit": {}, "_token": {}}

    def word(self, word: str) -> float:
        """What a word adds to the logit of its sentence, before the mean: the layers are linear, so one number is enough."""
        x = self._logit.get(word)
        if x is None:
            if len(self._logit) > 300_000:
                self._logit.clear()
            e = self.embeddings[features(word, len(self.embeddings))].mean(axis=0)
            x = self._logit[word] = float(e @ (self.weights[:, 1] - self.weights[:, 0]))
        return x

    def sentence(self, words: tuple[str, ...]) -> float:
        """Probability that a sentence is abusive."""
        z = sum(map(self.word, words)) / (len(words) + PAD) + float(self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + np.exp(-z)) if z > -500 else 0.0

    def token(self, token: str) -> float | None:
        """What a token as written adds, None if it holds no word; kept, so that each spelling is taken apart once per worker."""
        x = self._token.get(token, 0)
        if x == 0:
            if len(self._token) > 300_000:
                self._token.clear()
            plain = _plain(token)
            x = self._token[token] = (self.word(plain) or 1e-12) if plain else None
        return x

    def score(self, text: str | None) -> float:
        """The score of the worst sentence; 0 for null and empty texts."""
        if not text:
            return 0.0
        worst = -np.inf
        for tokens in raw_sentences(text):
            parts = [x for x in map(self.token, tokens) if x is not None]
            if parts:
                worst = max(worst, sum(parts) / (len(parts) + PAD))
        z = worst + float(self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + math.exp(-z)) if z > -500 else 0.0


def _train(words: _Bag, bag: _Bag, weight: np.ndarray, steps: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias that fit the weighted (not abusive, abusive) counts of each sentence.

    Gradient steps with momentum, one length for the whole table: a bucket moves as far as the evidence for it, so names and
    invented words that stand in one sentence hardly move, and buckets never seen stay at zero.
    """
    total = weight.sum()
    params = [np.zeros((words.n_columns, dim), dtype=np.float32), np.random.default_rng(seed).normal(0, 1, (dim, 2)).astype(np.float32), np.log(np.maximum(weight.sum(axis=0) / total, 1e-6)).astype(np.float32)]
    speed = [np.zeros_like(p) for p in params]
    weight = weight / total
    both = weight.sum(axis=1, keepdims=True)
    for t in range(steps):
        sv = bag.mean(words.mean(params[0]))
        z = sv @ params[1] + params[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p * both - weight).astype(np.float32)
        grads = [words.gradient(bag.gradient(d @ params[1].T)), sv.T @ d, d.sum(axis=0)]
        rate = 1.0 - 0.7 * t / steps
        for k, (g, length) in enumerate(zip(grads, (STEP, 0.05, 0.05))):
            speed[k] = 0.8 * speed[k] + 0.2 * g / (float(np.sqrt((g * g).sum())) + 1e-12)
            params[k] = params[k] - (rate * length) * speed[k]
    return params[0], params[1], params[2]


def fit(docs: list[tuple[str, float]], other_weight: float = 1.0, rounds: int = 3, folds: int = 2, steps: int = 100, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7) -> AbuseModel:
    """Fit on (text, share of abusive votes). Documents with split votes are left out. Without both classes nothing is abusive.

    In every round the sentences of a document are judged by a model that was trained without it. `other_weight` says how many
    documents each one not voted abusive stands for; it only matters for the threshold.
    """
    kept = [(s, y > 0.5) for t, y in docs if y != 0.5 and (s := sentences(t or ""))]
    if len({y for _, y in kept}) < 2:
        return AbuseModel(np.zeros((buckets, dim), dtype=np.float32), np.zeros((dim, 2), dtype=np.float32), np.array([5.0, -5.0], dtype=np.float32))
    unique = sorted({s for ss, _ in kept for s in ss})
    sid = {s: i for i, s in enumerate(unique)}
    vocabulary = sorted({w for s in unique for w in s})
    wid = {w: i for i, w in enumerate(vocabulary)}
    grams = [features(w, buckets) for w in vocabulary]
    # only buckets that occur are trained; all others stay at zero
    seen = np.unique(np.fromiter((b for g in grams for b in g), dtype=np.int64))
    place = dict(zip(seen.tolist(), range(len(seen))))
    words = _Bag.of([[place[b] for b in g] for g in grams], len(seen))
    bag = _Bag.of([[wid[w] for w in s] for s in unique], len(vocabulary), PAD)
    own = [np.array([sid[s] for s in ss]) for ss, _ in kept]
    label = np.array([y for _, y in kept])
    fold = np.arange(len(kept)) % folds
    guess: list[np.ndarray] = [np.full(len(ids), 1.0 / len(ids)) for ids in own]
    harmless = [np.zeros(len(ids)) for ids in own]
    used, threshold = np.ones(len(kept), dtype=bool), 0.5
    for r in range(rounds + 1):
        judged: list[np.ndarray] = [np.zeros(0)] * len(kept)
        for f in range(folds) if r < rounds else [-1]:
            weight = np.zeros((len(unique), 2))
            for ids, y, g, calm, use, k in zip(own, label, guess, harmless, used, fold):
                if use and k != f:
                    np.add.at(weight[:, 1], ids, g * y)
                    np.add.at(weight[:, 0], ids, calm if y else 1.0)
            # a very frequent sentence counts no more than some, but keeps its ratio of votes
            weight /= np.maximum(1.0, weight.sum(axis=1, keepdims=True) / 50)
            weight[:, 1] *= POSITIVE * weight[:, 0].sum() / max(weight[:, 1].sum(), 1e-9)
            # sentences without weight, and words that only they have, move nothing
            heavy = weight.sum(axis=1) > 0
            own_words = np.unique(bag.columns[np.repeat(heavy, bag.sizes)])
            mask = np.zeros(len(vocabulary), dtype=bool)
            mask[own_words] = True
            fitted = _train(words.only(mask), bag.only(heavy, own_words), weight[heavy].astype(np.float32), steps, dim, seed)
            z = bag.mean(words.mean(fitted[0])) @ fitted[1] + fitted[2]
            prob = 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))
            if f < 0:
                # models of the folds see less and dare less: not under half of what nine in ten abusive documents reach now
                reach = [prob[ids].max() for ids, y, use in zip(own, label, used) if y and use]
                table = np.zeros((buckets, dim), dtype=np.float32)
                table[seen] = fitted[0]
                return AbuseModel(table, *fitted[1:], threshold=max(threshold, 0.5 * float(np.quantile(reach, 0.1))) if reach else 0.5)
            for k in np.flatnonzero(fold == f):
                judged[k] = prob[own[k]]
        # a sentence of an abusive document stays abusive if it stands out from nearly all sentences of the others
        usual = np.quantile(np.concatenate([p for p, y in zip(judged, label) if not y]), USUAL)
        worst = np.array([p.max() for p in judged])
        # half of what the clearest abusive documents reach, one half at most; in the first round scores don't mean much yet
        floor = min(0.5, 0.5 * float(np.quantile(worst[label], 0.9)))
        guess = [(p > (max(usual, floor) if r else usual)).astype(float) for p in judged]
        # what lies between is left out of the next round
        harmless = [(p <= usual).astype(float) for p in judged]
        # an abusive vote on a document without any such sentence is taken for an error; harmless ones all count, as those the
        # model doubts are the ones it has most to learn from
        used = np.where(label, worst > usual, True)
        threshold = max(floor, _best_threshold(worst, label, other_weight))


def _best_threshold(score: np.ndarray, label: np.ndarray, other_weight: float) -> float:
    """The middle of the scores between which the votes are met best (F1)."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.cumsum(np.where(label[order], 1.0, other_weight)) + label.sum())
    k = int(np.argmax(f1))
    low = score[order[k + 1]] if k + 1 < len(score) else 0.0
    return float((score[order[k]] + low) / 2)


def labelled_sample(documents: DataFrame, votes: DataFrame, max_abusive: int = MAX_ABUSIVE, max_others: int = MAX_OTHERS, max_chars: int = MAX_CHARS) -> tuple[list[tuple[str, float]], float]:
    """(text, share of abusive votes) of a bounded sample of the labelled documents, and how many each of the others stands for.

    Null votes don't count; documents with as many votes for as against are left out, and so are votes on documents that
    don't exist. The sample takes the least hashes of the ids; a document that would pass `max_chars` is left out whole.
    """
    share = votes.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    sizes = share.agg(F.count_if(F.col("share") > 0.5).alias("abusive"), F.count_if(F.col("share") < 0.5).alias("others")).first()
    n_others = sizes["others"]
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    # ids that hash under a bar first, so that no task sends more than its share of the bounded sample
    bar = lambda n, of: F.lit(int(min(1.0, 1.2 * n / max(1, of)) * (1 << 30)))
    drawn = [share.where(c & (h < bar(n, of))).orderBy(h, "doc_id").limit(n) for c, n, of in ((F.col("share") > 0.5, max_abusive, sizes["abusive"]), (F.col("share") < 0.5, max_others, n_others))]
    texts = documents.select("doc_id", "text").where("text <> ''")
    chosen = drawn[0].unionByName(drawn[1])
    # lengths first, of the bounded sample alone; a text comes to the driver only within the bound on all of them
    sizes_ = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", h.alias("h"), F.length("text").alias("n")).collect()
    kept, total = set(), 0
    for r in sorted(sizes_, key=lambda r: (r["h"], r["doc_id"], r["n"])):
        if total + r["n"] <= max_chars:
            kept.add(r["doc_id"])
            total += r["n"]
    ids = documents.sparkSession.createDataFrame([(k,) for k in sorted(kept)], "doc_id long")
    rows = texts.join(F.broadcast(chosen.join(F.broadcast(ids), "doc_id")), "doc_id").select("doc_id", "text", "share").collect() if kept else []
    taken = [(r["text"], r["share"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]
    return taken, n_others / max(1, min(n_others, max_others))


def score_documents(documents: DataFrame, model: AbuseModel, *columns: str) -> DataFrame:
    """(doc_id, columns, score, abusive) of every document. Null and empty texts score 0."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["score"] = [own.score(t) for t in pdf["text"]]
            yield out

    kinds = "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    scored = documents.select("doc_id", *columns, "text").mapInPandas(run, f"doc_id long{kinds}, score double")
    return scored.withColumn("abusive", F.col("score") >= model.threshold)


def rates_by_source(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_abusive, rate, mean_score) by source without regard to case and surrounding blanks; null sources are one row."""
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    return scored.groupBy(name.alias("source")).agg(
        F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
