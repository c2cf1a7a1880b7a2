"""Problem 4: occurrences and record counts of every term, with a mark on those too rare or too common.

Each record's terms are emitted in order, the first of each kind marked, so that occurrences and records are counted side by
side; they are combined by hash on each map task and summed: one shuffle, of (term, n, records). A record is one row, so its
own counts need no shuffle. Nothing is collected; the number of records with a term is one row. A term that stands in a third
of all records reaches the reducers as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term: a letter, then letters, apostrophes and hyphens.
TERM = r"\p{L}[\p{L}'\-]*"


def terms_of(text: Column) -> Column:
    """All terms of a text in order, lower case, with a curly apostrophe read as a plain one. Null gives null."""
    return F.transform(F.regexp_extract_all(F.translate(text, "’", "'"), F.lit(TERM), F.lit(0)), F.lower)


def term_frequencies(records: DataFrame, texts: str, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """(term, n_occurrences, n_records, mark) over `records`, one row each, which hold an array of texts.

    Terms never run across two texts of the array. Null arrays and texts hold no term; records without a term don't count
    as records. `mark` is 'rare' below `rare_below` records, 'common' above that share of the records, else 'useful'; a term
    that is both is rare. No records give no rows.
    """
    # the terms of a record in order, so that the first of each kind counts the record; an outer explode, as the filter that a
    # plain one infers would cut every text into terms a second time
    own = records.select(F.sort_array(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), terms_of))).alias("__t"))
    marked = F.transform("__t", lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (t == F.get("__t", i - 1)), 0).otherwise(1).alias("__first")))
    found = own.select(F.explode_outer(marked).alias("__e")).select("__e.*").where("term is not null")
    terms = found.groupBy("term").agg(F.count("*").alias("n_occurrences"), F.sum("__first").alias("n_records"))
    # a record has a term if one of its texts has a letter, which is found without cutting it into terms
    total = records.where(F.exists(texts, lambda t: t.rlike(r"\p{L}"))).agg(F.count("*").alias("__total"))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * F.col("__total"), "common").otherwise("useful")
    return terms.join(F.broadcast(total)).select("term", "n_occurrences", "n_records", mark.alias("mark"))
