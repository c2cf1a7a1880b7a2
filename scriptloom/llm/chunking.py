"""Problem 2: cut texts above a size limit into overlapping pieces at natural boundaries.

Balanced targets. For a text of n characters, limit m and overlap v the least number of pieces is
k = ceil((n - v) / (m - v)); k - 1 targets lie at equal distances and each is snapped to the strongest boundary near it. Where a
piece then breaks the limit, the text is laid out again with one piece more, and with two. A text that still has no room to
move keeps the pieces up to the one that breaks the limit, and the rest is laid out by itself in the same way; the first
piece of a rest always keeps the limit, so this comes to an end on any text.

Boundaries, strongest first: between speeches (a line break), between paragraphs (an empty line; inside one unit),
after a sentence, between words, anywhere but inside a character that is written in several code points (a letter with
combining accents, a joined emoji); only a single one longer than all the room there is may be cut. A piece after the first
begins about `overlap` characters before the end of the one before, at the nearest boundary. All lengths are counted in
Unicode code points.

Texts within the limit pass through the JVM as one piece; only longer ones reach Python, in Arrow batches. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a cut before a position, and its name; -1 is inside a character.
KINDS = ("none", "word", "sentence", "paragraph", "speech")
_BREAKS = ((1, re.compile(r"\s+")), (2, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+")), (3, re.compile(r"\n\s*\n\s*")))
_CHARACTER = regex.compile(r"\X")


def boundaries(text: str, speech_starts: set[int] | None = None) -> np.ndarray:
    """For every position 0..n the strength of a cut there."""
    at = np.zeros(len(text) + 1, dtype=np.int8)
    for strength, rx in _BREAKS:
        for m in rx.finditer(text):
            at[m.end()] = max(at[m.end()], strength)
    if not text.isascii() or "\r\n" in text:
        for m in _CHARACTER.finditer(text):
            if m.end() - m.start() > 1:
                at[m.start() + 1 : m.end()] = -1
    starts = speech_starts if speech_starts is not None else {m.end() for m in re.finditer(r"\n", text)}
    for p in starts:
        at[p] = 4
    at[0] = at[len(text)] = 4
    return at


#: Worth of a cut by strength, the last entry that of a cut inside a character.
_WORTH = np.array((0, 4, 8, 11, 13, -99))


def _snap(at: np.ndarray, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high]; of equals the nearest to the target. Strength counts for the square of its rank
    against distance, so a far speech does not beat a sentence beside the target."""
    low, high = max(low, 1), min(high, len(at) - 1)
    if low >= high:
        return max(low, 1)
    span = np.arange(low, high + 1)
    worth = _WORTH[at[low : high + 1]] - 12.0 * np.abs(span - target) / max(high - low, 1)
    return int(span[np.argmax(worth)])


def _lay(at: np.ndarray, start: int, last: int, k: int, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int, bool]:
    """`k` pieces from `start` on, of equal length before they are snapped; the pieces that keep the limit, where the next one begins,
    and whether the text is covered."""
    n, base, pieces = len(at) - 1, start, []
    each = (n - base + (k - 1) * overlap) / k
    slack = max(0, int(min(limit - each, (each - overlap) / 2)))
    for i in range(1, k + 1):
        target = base + round(i * (each - overlap) + overlap)
        low, high = max(target - max(slack, int(each / 8)), start + overlap + 1, last + 1), min(target + slack, start + limit, n - 1)
        if n - start <= limit and (i == k or low > high):
            return [*pieces, (start, n, 4)], n, True
        if i == k or low > high:
            break
        last = _snap(at, target, low, high)
        pieces.append((start, last, int(at[last])))
        back = overlap // 3
        start = _snap(at, last - overlap, max(last - overlap - back, start + 1), min(last - overlap + back, last)) if overlap else last
    return pieces, start, False


def lay_out(text: str, limit: int, overlap: int, speech_starts: set[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece; the pieces cover the text and keep the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n, 4)]
    at = boundaries(text, speech_starts)
    least = lambda rest: max(1, -(-(rest - overlap) // (limit - overlap)))
    for more in range(3):
        pieces, start, done = _lay(at, 0, 0, least(n) + more, limit, overlap)
        if done:
            return pieces
    while not done:
        rest, start, done = _lay(at, start, pieces[-1][1], least(n - start), limit, overlap)
        pieces += rest
    return pieces


PIECE = "piece_no int, n_pieces int, start_pos int, end_pos int, boundary string, piece string"


def split_oversized(df: DataFrame, key: list[str], text: str, limit: int = 1200, overlap: int = 120, lengths: str | None = None) -> DataFrame:
    """One row per piece: key columns, piece_no from 1, n_pieces, start_pos and end_pos (code points, end excluded), boundary, piece.

    A null text gives no piece, an empty one a single empty piece. A text within the limit is one piece. Repeated rows are
    cut each for itself. `boundary` names what the piece ends at; the last piece ends at "speech". Other columns of `df`
    are dropped, so they can't clash. `lengths` names a column with the lengths of the speeches that one line break each
    joins to the text; without it, or where it is null, every line break counts as one between speeches.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    rows = df.select(*key, F.col(text).alias("__text"), (F.col(lengths) if lengths else F.lit(None)).cast("array<int>").alias("__lengths")).where(F.col("__text").isNotNull())
    short = rows.where(F.length("__text") <= limit).select(
        *key, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), F.length("__text").alias("end_pos"), F.lit("speech").alias("boundary"), F.col("__text").alias("piece")
    )

    def cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            src, out = [], []
            for i, (t, n) in enumerate(zip(pdf["__text"], pdf["__lengths"])):
                starts = None if n is None else set((np.cumsum(n) + np.arange(1, len(n) + 1))[:-1].tolist())
                pieces = lay_out(t, limit, overlap, starts)
                for j, (a, b, s) in enumerate(pieces):
                    src.append(i)
                    out.append((j + 1, len(pieces), a, b, KINDS[max(s, 0)], t[a:b]))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
            yield pd.concat([pdf[key].iloc[src].reset_index(drop=True), made], axis=1)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    long = rows.where(F.length("__text") > limit).mapInPandas(cut_rows, f"{keys}, {PIECE}")
    return short.unionByName(long)


def rebuild(pieces: DataFrame, key: list[str], limit: int, overlap: int) -> DataFrame:
    """(key, n_chars, digest, in_order, within_limit, overlaps_kept, was_cut): each text put together again from its pieces.

    `digest` is the MD5 of the text without the overlaps. The pieces of one text come together in one row, as the text did
    before it was cut. Keys must be unique among the texts.
    """
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece")))
    rows = pieces.groupBy(*key).agg(parts.alias("p"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("p", F.greatest(i, F.lit(1))).getField("end_pos"))
    own = F.transform("p", lambda x, i: F.struct(x["piece_no"].alias("no"), x["start_pos"].alias("a"), x["end_pos"].alias("b"), before(i).alias("c"), x["piece"].alias("t"), i.alias("i")))
    text = F.array_join(F.transform(own, lambda x: F.substring(x["t"], x["c"] - x["a"] + 1, F.length(x["t"]))), "")
    # a piece begins within a third of the overlap around the place that the overlap asks for
    kept = F.forall(own, lambda x: (x["i"] == 0) | (F.abs(x["c"] - x["a"] - overlap) <= overlap // 3))
    order = F.forall(own, lambda x: (x["no"] == x["i"] + 1) & (x["a"] <= x["c"]) & ((x["c"] < x["b"]) | (x["i"] == 0)) & (x["b"] - x["a"] == F.length(x["t"])))
    return rows.select(*key, F.length(text).alias("n_chars"), F.md5(text).alias("digest"), order.alias("in_order"), F.forall(own, lambda x: F.length(x["t"]) <= limit).alias("within_limit"), kept.alias("overlaps_kept"), (F.size("p") > 1).alias("was_cut"))
