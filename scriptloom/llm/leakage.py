"""Problem 6: evaluation passages that leaked, whole or in part, into documents.

Words are compared by their letters and digits alone, so case, punctuation, spacing and markup don't matter. Windows are cut
from every item at every position and from every document at every few words; their length follows the length of the items.

1. CGK random walk. A window x of W words becomes a string of 3W words: at step j the word under the pointer is written, and
   the pointer moves on if a random bit of (j, word) says so. Windows at a small edit distance agree in most places.
2. Bit-sampling LSH, repeated. Each repetition walks with its own random bits and hashes some places of the string; equal
   hashes make a document and an item meet. Equal windows always meet. The number of repetitions is computed: stretches as
   short as a leak can be, with as many words changed, added or dropped as are tolerated, must meet with `target` probability.
3. Exact edit verification. Windows that met must lie within the tolerated edit distance (a banded dynamic programme). A
   candidate's texts are then aligned: a stretch of the item's own wording is a run of its words that the document holds at an
   edit distance, exact in a band, of at most `max_changed` of its length. The item leaked if its stretches hold at least
   `share` of the words of its passage.

Sentences that many items begin with are an instruction and not part of the passage. A stretch must hold words that few items
have: phrases and names that many share are no leak. Both are counted over all items by aggregates.

The items never come to the driver together. They stream through it in blocks of bounded size, each block's hashes become one
broadcast, and a worker reads a batch of documents, tokenises and walks it once, and looks it up in all blocks; only more
blocks than `blocks_a_pass` take another pass over the documents. No shuffle of documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Parameters: of items from so many words on, the words of a window, the step of the document windows, sampled places.
CLASSES = ((0, 6, 2, 4), (40, 8, 3, 5))
MOST_REPETITIONS = 32

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-zA-Z]{2,8};|&#\d{1,7};")
_HYPHEN = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
# invisible format characters, and accents that stand by themselves
_HIDDEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u20d0-\u20ff\ufeff]")
_JOINED = re.compile(r"(?<=\w)['’](?=\w)")


def words_of(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation, markup, invisible characters and hyphenation at line ends."""
    if "<" in text or "&" in text:
        text = html.unescape(_MARKUP.sub(lambda m: html.unescape(m[0]) if m[0][0] == "&" else " ", text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    text = _JOINED.sub("", _HYPHEN.sub("", text))
    return _WORD.findall(text.casefold())


@lru_cache(1 << 17)
def _id(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def ids_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_id, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def signatures(ids: np.ndarray, starts: np.ndarray, window: int, repetitions: int, sampled: int, ends: np.ndarray | None = None) -> np.ndarray:
    """(repetitions, len(starts)) hashes of the windows of `ids` that begin at `starts` and stop at `ends` at the latest."""
    out = np.zeros((repetitions, len(starts)), dtype=np.uint64)
    if not len(starts):
        return out
    rows = np.append(ids, np.zeros(2 * window + 1, dtype=np.uint64))
    for r in range(repetitions):
        places = set(np.random.default_rng(1000 + r).choice(2 * window, sampled, replace=False).tolist())
        at, end = starts.astype(np.int64), starts.astype(np.int64) + window
        if ends is not None:
            end = np.minimum(end, ends)
        acc = np.full(len(starts), r + 1, dtype=np.uint64)
        salt = np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for j in range(max(places) + 1):
            now = np.where(at < end, rows[at], np.uint64(0))
            if j in places:
                acc = _mix(acc ^ now)
            bits = (_mix(now ^ salt ^ np.uint64(j * 0x2545F491)) >> np.uint64(40)) & np.uint64(1)
            at = np.where(at < end, at + bits.astype(np.int64), at)
        out[r] = acc
    return out


def repetitions_for(window: int, stride: int, sampled: int, stretch: int, max_changed: float, target: float, trials: int = 200) -> int:
    """The least number of repetitions at which a stretch of random words meets its copy with probability `target`, where every
    1 / `max_changed`-th word of the copy is replaced, or dropped, or followed by an added one; the worst of the three counts.

    Simulated with a fixed seed, as walks that part may come together again, for which there is no closed form.
    """
    rng = np.random.default_rng(20)
    every, most = max(2, round(1 / max_changed)), 0
    fresh = lambda: rng.integers(1, 1 << 62, dtype=np.uint64)
    for kind in ("replaced", "added", "dropped"):
        own, copy, own_at, copy_at, own_end, copy_end, own_of, copy_of = [], [], [], [], [], [], [], []
        for t in range(trials):
            item = rng.integers(1, 1 << 62, size=stretch + 2 * window, dtype=np.uint64).tolist()
            held = item[window : window + stretch]
            changed = []
            for i, w in enumerate(held):
                if i % every != every // 2:
                    changed.append(w)
                elif kind != "dropped":
                    changed += [w, fresh()] if kind == "added" else [fresh()]
            around = rng.integers(1, 1 << 62, size=2 * window + int(rng.integers(stride)), dtype=np.uint64).tolist()
            text = around[window:] + changed + around[:window]
            for words, ids, at, end, of, step in ((item, own, own_at, own_end, own_of, 1), (text, copy, copy_at, copy_end, copy_of, stride)):
                starts = range(len(ids), len(ids) + len(words) - window + 1, step)
                at += starts
                end += [len(ids) + len(words)] * len(starts)
                of += [t] * len(starts)
                ids += words
        met = np.zeros((MOST_REPETITIONS, trials), dtype=bool)
        pair = [signatures(np.array(ids, dtype=np.uint64), np.array(at), window, MOST_REPETITIONS, sampled, np.array(end)) for ids, at, end in ((own, own_at, own_end), (copy, copy_at, copy_end))]
        for r in range(MOST_REPETITIONS):
            a = {(h, t) for h, t in zip(pair[0][r].tolist(), own_of)}
            for h, t in zip(pair[1][r].tolist(), copy_of):
                if (h, t) in a:
                    met[r, t] = True
        reached = np.maximum.accumulate(met, axis=0).mean(axis=1) >= target
        most = max(most, int(np.argmax(reached)) + 1 if reached.any() else MOST_REPETITIONS)
    return most


@lru_cache(32)
def plan(shortest: int, share: float, max_changed: float, target: float) -> tuple[tuple[int, int, int, int, int], ...]:
    """(least words of an item, window, stride, sampled, repetitions) of each class, for leaks of `share` of an item."""
    out = []
    for least, window, stride, sampled in CLASSES:
        stretch = max(window + 2, LEAST, int(share * max(least, shortest)))
        out.append((least, window, stride, sampled, repetitions_for(window, stride, sampled, stretch, max_changed, target)))
    return tuple(out)


#: Words of the shortest stretch.
LEAST = 8


def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in order, and where each stands."""
    order = np.argsort(ids, kind="stable")
    return ids[order], order


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words replaced, added or dropped between two sequences; `most` + 1 where it is more than `most` (a band of that width)."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    before = np.arange(m + 1)
    for i in range(1, n + 1):
        low, high = max(1, i - most), min(m, i + most)
        now = np.full(m + 1, most + 1)
        if i <= most:
            now[0] = i
        cheap = np.minimum(before[low - 1 : high] + (b[low - 1 : high] != a[i - 1]), before[low : high + 1] + 1)
        # words added one after the other: the least of what lies before, one more for each step
        steps = np.arange(low, high + 1)
        row = np.minimum.accumulate(np.concatenate([[now[low - 1] - (low - 1)], cheap - steps])) + np.concatenate([[low - 1], steps])
        now[low : high + 1] = row[1:]
        before = now
    return int(min(before[m], most + 1))


def windows_within(x: np.ndarray, y: np.ndarray, x_len: np.ndarray, y_len: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For rows of two arrays of windows, whether one lies within `most` edits of a beginning of the other."""
    n, w = x.shape
    k = int(most.max(initial=0))
    far = np.int16(99)
    row = np.full((2 * k + 1, n), far, dtype=np.int16)
    row[k:] = np.arange(k + 1)[:, None]
    best = np.full(n, far, dtype=np.int16)
    for i in range(w + 1):
        if i:
            now = np.full((2 * k + 1, n), far, dtype=np.int16)
            for o in range(2 * k + 1):
                j = i + o - k
                if not 0 <= j <= w:
                    continue
                cost = row[o] + (x[:, i - 1] != y[:, j - 1]) if j else np.full(n, i, dtype=np.int16)
                if o < 2 * k:
                    cost = np.minimum(cost, row[o + 1] + 1)
                if o:
                    cost = np.minimum(cost, now[o - 1] + 1)
                now[o] = cost
            row = now
        for o in range(2 * k + 1):
            j = i + o - k
            if 0 <= j <= w:
                # one of the two has come to its end
                np.minimum(best, row[o], out=best, where=((x_len == i) & (y_len >= j)) | ((y_len == j) & (x_len >= i)))
    return best <= most


def stretches(item: np.ndarray, where: tuple[np.ndarray, np.ndarray], doc: np.ndarray, rare: np.ndarray | None = None, least: int = LEAST, max_changed: float = 0.2, own_words: float = 0.6) -> np.ndarray:
    """Which words of the item stand in the document in stretches of the item's own wording. `where` are the item's `places`.

    Along each diagonal, equal words no more than three apart make a run. A stretch begins with a run and is led on, over added
    and dropped words, to runs on neighbouring diagonals, as long as its edit distance to the document's words stays within
    `max_changed` of its length; it needs at least `least` words. The distance is counted from the runs where that bound is
    good enough, else computed in a band. With `rare`, the words that few items have, at least `own_words` of those in a stretch
    must be equal, and there must be one: a phrase that many items share is no wording of its own.
    """
    held = np.zeros(len(item), dtype=bool)
    lo, hi = np.searchsorted(where[0], doc, "left"), np.searchsorted(where[0], doc, "right")
    n = hi - lo
    if not n.any():
        return held
    j = np.repeat(np.arange(len(doc)), n)
    i = where[1][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    order = np.lexsort((i, j - i))
    i, d = i[order], (j - i)[order]
    cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) > 4)) + 1
    first, last = np.append(0, cuts), np.append(cuts, len(i))
    runs = [(int(i[a]), int(i[b - 1]) + 1, int(d[a]), i[a:b]) for a, b in zip(first.tolist(), last.tolist()) if b - a >= 2]
    runs.sort(key=lambda r: (r[0], r[2]))
    used = [False] * len(runs)
    for x, (s, e, d, at) in enumerate(runs):
        if used[x]:
            continue
        chain, end, dd = [x], e, d
        edits = (e - s) - len(at)
        for y in range(x + 1, len(runs)):
            s2, e2, d2, at2 = runs[y]
            if s2 > end + 3:
                break
            if used[y] or d2 == dd or abs(d2 - dd) > 3 or e2 <= end or s2 < end - 2:
                continue
            # what the two runs share in either text is taken from the second one
            begin = max(s2, end, end + dd - d2)
            kept = int((at2 >= begin).sum())
            more = edits + max(begin - end, begin + d2 - end - dd) + (e2 - begin) - kept
            if not kept or more > max_changed * (e2 - s) and edit_distance(item[s:e2], doc[s + d : e2 + d2], int(max_changed * (e2 - s))) > max_changed * (e2 - s):
                continue
            chain.append(y)
            edits, end, dd = more, e2, d2
        length = end - s
        if length >= least and _own(rare, s, end, [runs[y][3] for y in chain], own_words):
            if edits <= max_changed * length or edit_distance(item[s:end], doc[s + d : end + dd], int(max_changed * length)) <= max_changed * length:
                for y in chain:
                    used[y] = True
                # a changed word inside a stretch is part of it
                held[s:end] = True
    return held


def _own(rare: np.ndarray | None, start: int, end: int, equal: list[np.ndarray], share: float) -> bool:
    """Whether enough of the rare words of a stretch are equal."""
    if rare is None:
        return True
    n = int(rare[start:end].sum())
    same = np.unique(np.concatenate(equal))
    return n > 0 and int(rare[same].sum()) >= share * n


class ItemBlock:
    """The hashes and words of a block of items of one class, as sent to the workers."""

    def __init__(self, items: dict[int, list[str]], common: set[str] | None, window: int, repetitions: int, sampled: int):
        self.window = window
        self.names = np.array(list(items), dtype=np.int64)
        ids = [ids_of(w) for w in items.values()]
        self.rare = [None if common is None else np.array([w not in common for w in words], dtype=bool) for words in items.values()]
        self.words = np.concatenate([*ids, np.zeros(0, dtype=np.uint64)])
        self.ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        base = self.ends - [len(x) for x in ids]
        starts = np.concatenate([np.arange(max(1, len(x) - window + 1)) + b for x, b in zip(ids, base) if len(x)] or [np.zeros(0, dtype=np.int64)])
        own = np.searchsorted(self.ends, starts, "right")
        sig = signatures(self.words, starts, window, repetitions, sampled, self.ends[own])
        self.start = np.tile(starts.astype(np.int32), repetitions)
        order = np.argsort(sig.ravel(), kind="stable")
        self.sig, self.start = sig.ravel()[order], self.start[order]
        self._places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._own: dict[int, frozenset] = {}

    def item(self, k: int) -> np.ndarray:
        return self.words[self.ends[k - 1] if k else 0 : self.ends[k]]

    def candidates(self, docs: list[np.ndarray], walked: tuple, max_changed: float) -> list[tuple[int, int]]:
        """(place in `docs`, place of the item) of every document and item with windows that met and lie within the tolerance."""
        words, ends, own, first, sig = walked
        lo, hi = np.searchsorted(self.sig, sig, "left"), np.searchsorted(self.sig, sig, "right")
        n = hi - lo
        met = np.flatnonzero(n)
        w, steps, found = self.window, np.arange(self.window), set()
        # hits are laid out in slices, so that a hash that many share takes no more memory than one that few share
        done, total = 0, np.concatenate([[0], np.cumsum(n[met])])
        while done < total[-1]:
            upto = min(done + 100_000, int(total[-1]))
            k = np.searchsorted(total, np.arange(done, upto), "right") - 1
            h = met[k] % len(own)
            at = self.start[lo[met[k]] + np.arange(done, upto) - total[k]].astype(np.int64)
            it = np.searchsorted(self.ends, at, "right")
            done = upto
            new = np.unique(np.stack([h, at, own[h], it]), axis=1)
            h, at, d, it = new
            x_len, y_len = np.minimum(ends[d] - first[h], w), np.minimum(self.ends[it] - at, w)
            x = np.where(steps < x_len[:, None], words[np.minimum(first[h][:, None] + steps, len(words) - 1)], np.uint64(0))
            y = np.where(steps < y_len[:, None], self.words[np.minimum(at[:, None] + steps, len(self.words) - 1)], np.uint64(1))
            ok = windows_within(x, y, x_len, y_len, np.ceil(max_changed * np.minimum(x_len, y_len)).astype(np.int64))
            found.update(zip(d[ok].tolist(), it[ok].tolist()))
        return sorted(found)

    def held(self, k: int, doc: np.ndarray, doc_words: frozenset, max_changed: float) -> float:
        """The share of an item's words that stand in stretches of a document."""
        ids = self.item(k)
        if k not in self._places:
            self._places[k] = places(ids)
            self._own[k] = frozenset(ids.tolist() if self.rare[k] is None else ids[self.rare[k]].tolist())
        # every stretch holds a rare word, so a document without any of them needs no alignment
        if self._own[k].isdisjoint(doc_words):
            return 0.0
        return float(stretches(ids, self._places[k], doc, self.rare[k], max_changed=max_changed).mean())


def walk(docs: list[np.ndarray], window: int, stride: int, repetitions: int, sampled: int) -> tuple | None:
    """(all words, ends of the documents, document and start of each window, hashes of all windows); None where there is none."""
    starts, owner, base = [], [], 0
    for d, ids in enumerate(docs):
        if len(ids):
            last = max(0, len(ids) - window)
            at = np.arange(0, last + stride, stride)
            at[-1] = last
            starts.append(at + base)
            owner.append(np.full(len(at), d))
            base += len(ids)
    if not starts:
        return None
    ends = np.cumsum([len(ids) for ids in docs])
    own, first, words = np.concatenate(owner), np.concatenate(starts), np.concatenate(docs)
    return words, ends, own, first, signatures(words, first, window, repetitions, sampled, ends[own]).ravel()


def passages(items: DataFrame, shared_by: int = 3) -> DataFrame:
    """(item_id, words): the words of each item's passage, without a first sentence that at least `shared_by` items share.

    Repeated item ids are read once, by their least text; null ids and texts are left out.
    """
    texts = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                first, _, rest = re.sub(r"\s+", " ", text).strip().partition(next(iter(re.findall(r"[.!?:] ", text)), "\0"))
                rows.append((item, " ".join(words_of(first)), words_of(rest), words_of(text)))
            yield pd.DataFrame(rows, columns=["item_id", "head", "rest", "whole"])

    split = texts.mapInPandas(part, "item_id long, head string, rest array<string>, whole array<string>")
    shared = split.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by).select("head", F.lit(True).alias("shared"))
    # a sentence that a third of the items begin with is a hot key of this join; adaptive execution splits it
    return split.join(shared, "head", "left").select("item_id", F.when(F.col("shared") & (F.size("rest") > 0), F.col("rest")).otherwise(F.col("whole")).alias("words"))


def common_words(items: DataFrame, share: float = 0.02, least: int = 2) -> set[str]:
    """Words that more than `share` of the items have, and more than `least` of them.

    They are at most 1 / `share` times the different words of an item of average length, so they fit the driver.
    """
    bar = max(least, share * items.count())
    return {r["w"] for r in items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > bar).select("w").collect()}


def _blocks(items: DataFrame, common: set[str], classes: tuple, block_items: int, block_words: int) -> Iterator[tuple[tuple, ItemBlock]]:
    """Blocks of the items of each class, in the order of their ids. One block at a time is on the driver."""
    for c, (least, window, stride, sampled, repetitions) in enumerate(classes):
        below = classes[c + 1][0] if c + 1 < len(classes) else None
        own = items.where((F.size("words") >= max(least, 1)) & (F.lit(True) if below is None else F.size("words") < below)).orderBy("item_id")
        held: dict[int, list[str]] = {}
        size = 0
        for r in own.toLocalIterator():
            if held and (len(held) >= block_items or size + len(r["words"]) > block_words):
                yield (window, stride, repetitions, sampled), ItemBlock(held, common, window, repetitions, sampled)
                held, size = {}, 0
            held[r["item_id"]] = r["words"]
            size += len(r["words"])
        if held:
            yield (window, stride, repetitions, sampled), ItemBlock(held, common, window, repetitions, sampled)


def _leaks(blocks: list[tuple[tuple, ItemBlock]], texts: list[str], share: float, max_changed: float) -> Iterator[tuple[int, int, float]]:
    """(place in `texts`, item, share of the passage held). Long texts are walked by themselves, so memory stays flat."""
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= 400_000):
            size += len(texts[end])
            end += 1
        docs = [ids_of(words_of(t)) for t in texts[k:end]]
        walks: dict[tuple, tuple | None] = {}
        words: dict[int, frozenset] = {}
        for how, block in blocks:
            if how not in walks:
                walks[how] = walk(docs, *how)
            if walks[how] is not None:
                for d, i in block.candidates(docs, walks[how], max_changed):
                    if d not in words:
                        words[d] = frozenset(docs[d].tolist())
                    held = block.held(i, docs[d], words[d], max_changed)
                    if held >= share:
                        yield k + d, int(block.names[i]), held
        k = end


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, max_changed: float = 0.2, target: float = 0.97, block_items: int = 2000, block_words: int = 250_000, blocks_a_pass: int = 6) -> DataFrame:
    """(doc_id, item_id, held): documents that hold at least `share` of the words of an item's passage.

    Null and empty texts on either side match nothing; items with null ids are left out. Copies of a leaking document are found
    like the document. Repeated item ids are read once, by their least text. `target` is the probability with which a leak as
    short as `share` of the shortest item of its class, every fifth of its words changed (`max_changed`), becomes a candidate.
    Blocks hold at most `block_items` items and `block_words` words (or one longer item), some 30 MB on a worker; the documents
    are read once for every `blocks_a_pass` blocks.
    """
    spark = documents.sparkSession
    prepared = cut(passages(items))
    shortest = prepared.where(F.size("words") > 0).agg(F.min(F.size("words"))).first()[0] or 0
    classes = plan(int(shortest), share, max_changed, target)
    source = documents.select("doc_id", "text").where("text <> ''")
    out, held = None, []

    def one_pass(blocks: list) -> DataFrame:
        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = [(how, b.value) for how, b in blocks]
            for pdf in batches:
                doc_id = pdf["doc_id"].tolist()
                rows = [(doc_id[d], i, h) for d, i, h in _leaks(own, pdf["text"].tolist(), share, max_changed)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "held"]).astype({"doc_id": "int64", "item_id": "int64", "held": "float64"})

        return source.mapInPandas(match, "doc_id long, item_id long, held double")

    for how, block in _blocks(prepared, common_words(prepared), classes, block_items, block_words):
        held.append((how, spark.sparkContext.broadcast(block)))
        if len(held) == blocks_a_pass:
            out, held = one_pass(held) if out is None else out.unionByName(one_pass(held)), []
    if held or out is None:
        out = one_pass(held) if out is None else out.unionByName(one_pass(held))
    return out
