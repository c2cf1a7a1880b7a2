"""Problem 7: mix records from several sources to target shares of the total size, in tokens of a public tokenizer.

Soft-membership mixing.

1. Sizes: every document is tokenised once, in Arrow batches, by a vocabulary that is broadcast with the job.
2. A classifier is fitted on a bounded sample of documents whose source is a listed one (hashed words, softmax, numpy) and
   predicts for every document without a name how likely it belongs to each listed source. A document with a listed name
   belongs to it; one with another name belongs to none.
3. Distributed projected-gradient least squares finds a nonnegative rate for every document, at most the number of repeats
   its source allows, so that the expected tokens of each source come near its share. Documents of equal membership have
   equal rates, so they are added up first: a source's named documents are one row, whatever their number. One step is one
   aggregate of a row per source; the rates follow from the gradients of the steps so far, which the next step applies in the
   same scan, so no table of rates is ever written. The named documents are fitted first; a source whose every document then
   stands at its cap and still lacks tokens cannot reach its share by its own name. Unnamed documents join after that.
4. Rates become whole copies: the whole part, and one more for documents in random order until the tokens that the rates ask
   for are met. The random order is cut by sums over buckets; only the bucket that crosses the bar is put in order.

The report tells what each source got by name, in whole copies, beside what was asked for.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

TOKENIZERS = "/opt/tokenizers"
#: Bound on the documents the classifier is fitted on (drawn by a hash of their ids, whole texts), and its hash buckets.
MAX_LABELLED, BUCKETS = 4000, 1 << 14

_WORD = re.compile(r"\w+")
_PART = re.compile(r"(?<=\S) ")


@lru_cache(2)
def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public_byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def vocabulary(folder: str) -> bytes:
    """The ranks of the byte-level BPE in `folder`, as they are sent to the workers (half a megabyte)."""
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


def tokenizer(folder: str):  # noqa: ANN201
    """Byte-level BPE of a public vocabulary, by the ranks in `folder`."""
    return _encoding(vocabulary(folder))


def count_tokens(text: str, enc: object, stretch: int = 100_000) -> int:
    """Tokens of a text. Long texts are counted in stretches cut before a blank that follows something else, where the pattern
    always parts, so the count is that of the whole text; a stretch without such a place is as long as it has to be."""
    n = at = 0
    while at < len(text):
        end = len(text)
        if end - at > stretch:
            gap = _PART.search(text, at + stretch)
            end = gap.start() if gap else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def normal_source(c: Column) -> Column:
    """A source name without regard to case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _bag(text: str) -> np.ndarray:
    """The distinct hash buckets of a text's words."""
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in words), dtype=np.int64, count=len(words)))


class SourceModel:
    """Softmax over hashed words. Fixed size: buckets x sources."""

    def __init__(self, n_sources: int):
        self.weights = np.zeros((BUCKETS, n_sources), dtype=np.float32)
        self.bias = np.zeros(n_sources, dtype=np.float32)

    def logits(self, bag: np.ndarray) -> np.ndarray:
        return self.weights[bag].sum(axis=0) / np.sqrt(max(len(bag), 1)) + self.bias

    def posterior(self, text: str | None) -> np.ndarray:
        """Probabilities of the sources; the prior of the sample for null and empty texts."""
        z = self.logits(_bag(text or "")).astype(np.float64).round(4)
        p = np.exp(z - z.max())
        return p / p.sum()

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 3, rate: float = 0.3) -> SourceModel:
        """Stochastic gradient over the sample, in a fixed order."""
        counts = np.bincount(labels, minlength=len(self.bias))
        self.bias = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts))).astype(np.float32)
        order = np.random.default_rng(5)
        for e in range(epochs):
            for k in order.permutation(len(bags)):
                b = bags[k]
                if len(b):
                    z = self.logits(b)
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[labels[k]] -= 1
                    self.weights[b] -= (rate / (1 + e) / np.sqrt(len(b)) * p).astype(np.float32)
        return self


def _sample(documents: DataFrame, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of at most `MAX_LABELLED` documents of listed sources, by least hashes of their ids. Only the buckets of the
    words come to the driver, at most `BUCKETS` numbers a document."""
    named = documents.select("doc_id", normal_source(F.col("source")).alias("source"), "text").where(F.col("source").isin(names) & (F.col("text") != ""))
    # ids that hash under a bar first: the bar follows the number of named documents, so no task sends more than its share
    bar = min(1.0, 1.2 * MAX_LABELLED / max(1, named.count()))
    drawn = named.withColumn("__h", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))).where(F.col("__h") < F.lit(int(bar * (1 << 30))))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["__h"], "doc_id": pdf["doc_id"], "source": pdf["source"], "bag": [_bag(t).astype(np.int32) for t in pdf["text"]]})

    rows = drawn.select("__h", "doc_id", "source", "text").mapInPandas(bags, "h long, doc_id long, source string, bag array<int>").orderBy("h", "doc_id").limit(MAX_LABELLED).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["source"], r["bag"]))
    return [np.array(r["bag"], dtype=np.int64) for r in rows], np.array([names.index(r["source"]) for r in rows], dtype=np.int64)


def _sized(documents: DataFrame, sources: list[str], model: SourceModel | None, folder: str) -> DataFrame:
    """(doc_id, source, kind, tokens, posterior) of every document; kind is listed, unlisted or unnamed."""
    held = documents.sparkSession.sparkContext.broadcast((model, vocabulary(folder)))
    place = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ranks = held.value
        enc, eye = _encoding(ranks), np.eye(len(sources))
        none = [0.0] * len(sources)

        def member(name: str | None, text: str | None) -> list[float]:
            if name in place:
                return eye[place[name]].tolist()
            return own.posterior(text).tolist() if own and not name else none

        for pdf in batches:
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "source": pdf["source"],
                    "kind": ["unnamed" if not s else "listed" if s in place else "unlisted" for s in pdf["source"]],
                    "tokens": [count_tokens(t, enc) if t else 0 for t in pdf["text"]],
                    "posterior": [member(s, t) for s, t in zip(pdf["source"], pdf["text"])],
                }
            )

    rows = documents.select("doc_id", normal_source(F.col("source")).alias("source"), "text")
    return rows.mapInPandas(run, "doc_id long, source string, kind string, tokens long, posterior array<double>")


def _rates(posterior: pd.Series, unnamed: np.ndarray, caps: np.ndarray, start: np.ndarray, steps: tuple) -> np.ndarray:
    """Rates after the given steps. A step (gradient, open) moves each rate against the gradient, seen through the membership, and
    back into [0, cap]; unnamed documents stay at 0 until a step opens the mix to them."""
    p = np.stack(posterior.to_numpy()) if len(posterior) else np.zeros((0, len(caps)))
    most = p @ caps
    rate = np.where(unnamed, 0.0, np.minimum(p @ start, most))
    for s, opened in steps:
        rate = np.where(unnamed & (not opened), 0.0, np.clip(rate - p @ s, 0.0, most))
    return rate


def whole_copies(rated: DataFrame, buckets: int = 4096, seed: int = 17) -> DataFrame:
    """`rated` (doc_id, source, kind, tokens, rate) with `copies`: the whole part of the rate, and one more for documents in random
    order, those of a higher rest sooner, until the tokens of each source that the rests ask for are met to half a document.

    Null ids are drawn together. A bucket of the random order holds about a 4096th of a source's documents.
    """
    base = F.floor(F.col("rate") + 1e-9)
    rows = rated.withColumn("__base", base.cast("int")).withColumn("__rest", F.greatest(F.col("rate") - base, F.lit(0.0)))
    luck = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    rows = rows.withColumn("__u", F.when(F.col("__rest") > 1e-9, luck / F.col("__rest"))).withColumn("__b", F.floor(F.col("__u") / (1 + F.col("__u")) * buckets).cast("int"))
    group = F.coalesce("source", F.lit(""))
    rows = rows.withColumn("__g", group)
    sums = rows.where("__b is not null").groupBy("__g", "__b").agg(F.sum("tokens").alias("__n"), F.sum(F.col("tokens") * F.col("__rest")).alias("__want"))
    over = W.partitionBy("__g")
    sums = sums.withColumn("__all", F.sum("__want").over(over)).withColumn("__upto", F.sum("__n").over(over.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)))
    # the first bucket in which the sum passes the bar, and what is left for it; at most one row a source
    edge = sums.where(F.col("__upto") >= F.col("__all")).groupBy("__g").agg(F.min("__b").alias("__cut"), F.min_by(F.col("__all") - F.col("__upto") + F.col("__n"), "__b").alias("__left"))
    marked = rows.join(edge, "__g", "left")
    clear = marked.where("__b is null or __cut is null or __b <> __cut").withColumn("__more", F.when(F.col("__b") < F.col("__cut"), 1).otherwise(0))
    within = F.sum("tokens").over(W.partitionBy("__g").orderBy("tokens", "__u", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    crossing = marked.where("__b = __cut").withColumn("__more", (within - F.col("tokens") / 2 <= F.col("__left")).cast("int"))
    return clear.unionByName(crossing).select(*rated.columns, (F.col("__base") + F.col("__more")).cast("int").alias("copies"))


def mix_sources(documents: DataFrame, weights: DataFrame, tokenizers: str = TOKENIZERS, total: int | None = None, iterations: int = 25, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """The mix and a report.

    Mix: (doc_id, source, tokens, rate, copies), one row per document, also those with no copy. Report, one row per listed
    source as written (kind 'listed') and one each for unlisted and unnamed documents (null source): kind, target_weight,
    max_repeats, own_docs, own_tokens (documents of that name), total_tokens (of all documents, unnamed and unlisted ones
    included), needed_tokens, reachable (false where the fit leaves every document of the name at its cap and still lacks
    tokens), rate_tokens and mixed_tokens (by name, before and after the rates became whole copies), actual_share (of all
    tokens of the mix, by name), soft_tokens (expected tokens with the unnamed documents' memberships), reachable_total (the
    largest size of a mix in which every source has its share by name; give it as `total` for exact shares), passes and
    converged: whether the targets were met, or the last step moved less than `tolerance` / 10 of all tokens; false if
    `iterations` steps did not settle it.

    Null text is size 0. Names are compared without regard to case and surrounding blanks; listed names that fall together
    are added up under the first; a null or blank name is none. A null weight is 0, a null cap 1. `total` is the size of the
    mix; all documents' size where it is None. Documents with a null id are counted, too.
    """
    spark = documents.sparkSession
    listed = weights.where(normal_source(F.col("source")) != "").select(normal_source(F.col("source")).alias("name"), "source", F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
    listed = sorted((r.asDict() for r in listed.groupBy("name").agg(F.min("source").alias("source"), F.sum("w").alias("w"), F.max("r").alias("r")).collect()), key=lambda r: r["name"])
    names = [r["name"] for r in listed]
    n = len(names)
    caps, share = np.array([float(r["r"]) for r in listed]), np.array([float(r["w"]) for r in listed])
    sized = cut(_sized(documents, names, SourceModel(n).fit(*_sample(documents, names)) if n else None, tokenizers))
    by_name = {(r["kind"], r["source"] if r["kind"] == "listed" else None): (int(r["n"]), int(r["t"] or 0)) for r in sized.groupBy("kind", F.when(F.col("kind") == "listed", F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    everything = sum(t for _, t in by_name.values())
    own = np.array([float(by_name.get(("listed", x), (0, 0))[1]) for x in names])
    goal = share * (everything if total is None else total)
    scale = np.maximum(own, 1.0)
    start = np.minimum(goal / scale, caps)
    # documents of equal membership get equal rates
    unnamed = F.col("kind") == "unnamed"
    groups = cut(sized.where("kind <> 'unlisted'").groupBy("posterior", unnamed.alias("unnamed")).agg(F.sum("tokens").alias("tokens"))) if n else None
    shape = ", ".join([f"t{k} double" for k in range(n)] + [f"room{k} double" for k in range(n)])

    def fitted(steps: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each source, and the most any of its named documents is below its cap."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                free = pdf["unnamed"].to_numpy(dtype=bool)
                rate = _rates(pdf["posterior"], free, caps, start, steps)
                p = np.stack(pdf["posterior"].to_numpy()) if len(pdf) else np.zeros((0, n))
                room = np.where((p == 1.0) & ~free[:, None], caps - rate[:, None], 0.0).max(axis=0, initial=0.0)
                yield pd.DataFrame([[*((rate * pdf["tokens"].to_numpy()) @ p), *room]], columns=[c.split()[0] for c in shape.split(", ")])

        got = groups.mapInPandas(run, shape).agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(n)], *[F.max(f"room{k}").alias(f"room{k}") for k in range(n)]).first()
        return np.array([float(got[f"t{k}"] or 0) for k in range(n)]), np.array([float(got[f"room{k}"] or 0) for k in range(n)])

    steps: tuple = ()
    reachable, soft, passes, converged = np.zeros(n, dtype=bool), np.zeros(n), 0, n == 0
    for opened in (False, True) if n else ():
        before, converged = None, False
        for _ in range(iterations):
            soft, room = fitted(steps)
            passes += 1
            # the least squares are weighted by source size, so that a step of one closes a gap within a source at once
            gap = soft - goal
            off = float(np.abs(gap).sum() / max(goal.sum(), 1.0))
            converged = off < tolerance / 10 or before is not None and float(np.abs(soft - before).sum()) < tolerance / 10 * max(goal.sum(), 1.0)
            if converged:
                break
            before = soft
            steps = (*steps, (gap / scale, opened))
        if not opened:
            # every document at its cap, and tokens still lacking
            reachable = ~((room <= 0.0) & (soft < goal * (1 - 1e-9)))
    final = steps

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", "source", "kind", "tokens"]].copy()
            out["rate"] = _rates(pdf["posterior"], (pdf["kind"] == "unnamed").to_numpy(), caps, start, final) if n else 0.0
            yield out

    mix = whole_copies(sized.mapInPandas(rated, "doc_id long, source string, kind string, tokens long, rate double"))
    name = F.when(F.col("kind") == "listed", F.col("source")).alias("source")
    got = {(r["kind"], r["source"]): (float(r["r"] or 0), float(r["c"] or 0)) for r in mix.groupBy("kind", name).agg(F.sum(F.col("tokens") * F.col("rate")).alias("r"), F.sum(F.col("tokens") * F.col("copies")).alias("c")).collect()}
    mixed_all = sum(c for _, c in got.values())
    most = min((float(c * t / w) for c, t, w in zip(caps, own, share) if w > 0), default=0.0)
    lines = [("listed", r["name"], r["source"], float(r["w"]), int(r["r"]), bool(reachable[k]), float(soft[k])) for k, r in enumerate(listed)] + [(kind, None, None, None, None, None, None) for kind in ("unlisted", "unnamed")]
    rows = []
    for kind, key, source, w, r, ok, expected in lines:
        docs, tokens = by_name.get((kind, key), (0, 0))
        before, after = got.get((kind, key), (0.0, 0.0))
        rows.append((source, kind, w, r, docs, tokens, everything, None if w is None else w * everything, ok, before, after, after / mixed_all if mixed_all else 0.0, expected, most, passes, bool(converged)))
    schema = (
        "source string, kind string, target_weight double, max_repeats int, own_docs long, own_tokens long, total_tokens long, needed_tokens double, reachable boolean, rate_tokens double, "
        "mixed_tokens double, actual_share double, soft_tokens double, reachable_total double, passes int, converged boolean"
    )
    return mix.select("doc_id", "source", "tokens", "rate", "copies"), spark.createDataFrame(rows, schema)
