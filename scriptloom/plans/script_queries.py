"""Text, sequence, parsing, graph and vector queries over documents, scenes, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import text as tx
from ..operators import graph, screenplay, sequence, valence, vector
from ..operators.models import topics
from ..operators.ranking import quantiles
from ..session import cut, table
from ..streaming.events import windowed_counts
from .base import SCENES_SQL, UNITS_SQL, scenes, units
from .registry import Registry

query = Registry()

_TOK = r"list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*'), lambda x: lower(x))"
_FIRST = "('i', 'me', 'my', 'mine', 'myself')"
_SECOND = "('you', 'your', 'yours', 'yourself', 'yourselves', 'thou', 'thee', 'thy', 'thine', 'thyself')"
_DOCS = f"docs as (select doc_id, text, {_TOK} as toks from documents where text is not null)"
_WORDS = f"{_DOCS}, words as (select doc_id, unnest(toks) as w from docs)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null").withColumn("toks", tx.tokens(F.col("text")))


def _words(spark: SparkSession, d: str) -> DataFrame:
    # an outer explode, as the filter that a plain one infers would tokenise every text a second time
    return _docs(spark, d).select("doc_id", F.explode_outer("toks").alias("w")).where("w is not null")


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    f"""with {_WORDS}, c as (select doc_id, w, count(*) as n from words group by 1, 2), h as (select doc_id, sum(n)::bigint as n_tokens, count(*) as n_types, round(avg((n = 1)::int), 6) as hapax_ratio from c group by 1),
p as (select doc_id, round(count_if(w in {_FIRST}) / (count_if(w in {_SECOND}) + 1.0), 6) as pronoun_ratio from words group by 1)
select d.doc_id, coalesce(n_tokens, 0) as n_tokens, coalesce(n_types, 0) as n_types, hapax_ratio, pronoun_ratio, round(1000.0 * (length(text) - length(replace(text, '?', ''))) / greatest(n_tokens, 1), 4) as questions, v.votes
from docs d left join h using (doc_id) left join p using (doc_id) left join (select doc_id, sum(abusive)::bigint as votes from review_labels group by 1) v using (doc_id)"""
)
def lexical_profile(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, types, hapax and pronoun ratios and question rate of each document, with its votes.

    All word counts come from the array of a row, so there is no shuffle but the join with the votes.
    """
    docs = _docs(spark, d)
    # types and hapaxes from the sorted tokens of one row: a type begins where the neighbour before differs
    s = F.array_sort("toks")
    at = lambda i: F.get(F.col("s"), i)
    rows = docs.withColumn("s", s).withColumn("n_tokens", F.size("s").cast("long"))
    places = F.sequence(F.lit(0), F.col("n_tokens").cast("int") - 1)
    start = lambda i: (i == 0) | (at(i - 1) != at(i))
    end = lambda i: (i == F.col("n_tokens") - 1) | (at(i + 1) != at(i))
    types = F.when(F.col("n_tokens") > 0, F.size(F.filter(places, start))).otherwise(0).cast("long")
    once = F.when(F.col("n_tokens") > 0, F.size(F.filter(places, lambda i: start(i) & end(i))))
    first = F.size(F.filter("s", lambda w: w.isin(*tx.FIRST_PERSON)))
    second = F.size(F.filter("s", lambda w: w.isin(*tx.SECOND_PERSON)))
    votes = table(spark, d, "review_labels").groupBy("doc_id").agg(F.sum("abusive").cast("long").alias("votes"))
    return rows.select(
        "doc_id", "n_tokens", types.alias("n_types"), F.round(F.try_divide(once, types), 6).alias("hapax_ratio"), F.when(F.col("n_tokens") > 0, F.round(first / (second + 1.0), 6)).alias("pronoun_ratio"),
        F.when(F.col("n_tokens") > 0, F.round(1000.0 * tx.count_of(F.col("text"), "?") / F.greatest("n_tokens", F.lit(1)), 4)).otherwise(F.round(1000.0 * tx.count_of(F.col("text"), "?"), 4)).alias("questions"),
    ).join(votes, "doc_id", "left")


@query(
    f"""with {_DOCS}, f as (select doc_id, len(toks) as w, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')) as s,
list_sum(list_transform(toks, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - case when regexp_matches(x, '[^l]e$') and regexp_matches(x, '[^aeiouy]e$') then 1 else 0 end))) as y from docs)
select doc_id, w::int as n_words, s::int as n_sentences, y::bigint as n_syllables, round(3.9e-1 * w / s + 1.18e1 * y / w - 1.559e1, 4) as grade from f where w > 0 and s > 0"""
)
def flesch_kincaid(spark: SparkSession, d: str) -> DataFrame:
    """Reading grade of each document with words and sentences."""
    rows = _docs(spark, d).select("doc_id", F.size("toks").alias("n_words"), tx.sentence_count(F.col("text")).alias("n_sentences"), F.aggregate(F.transform("toks", tx.syllables), F.lit(0), lambda a, x: a + x).cast("long").alias("n_syllables"))
    grade = 0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syllables") / F.col("n_words") - 15.59
    return rows.where("n_words > 0 and n_sentences > 0").withColumn("grade", F.round(grade, 4))


@query(
    f"""with {UNITS_SQL}, l as (select imdb_id, text, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*')) as n from units where trim(text) <> '')
select imdb_id, count(*) as n_lines, round(avg(n), 6) as mean_tokens, round(stddev_pop(n), 6) as std_tokens, round(avg((n < 5)::int), 6) as share_short,
round(1000.0 * sum(length(text) - length(replace(text, '?', ''))) / greatest(sum(n), 1), 4) as questions, round(1000.0 * sum(length(text) - length(replace(text, '!', ''))) / greatest(sum(n), 1), 4) as exclamations from l group by 1"""
)
def line_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and punctuation of the dialogue lines of each film."""
    n = F.size(F.regexp_extract_all("text", F.lit(tx.TOKEN), F.lit(0)))
    rows = units(spark, d).where("trim(text) <> ''").select("imdb_id", "text", n.alias("n"))
    rate = lambda m: F.round(1000.0 * F.sum(tx.count_of(F.col("text"), m)) / F.greatest(F.sum("n"), F.lit(1)), 4)
    return rows.groupBy("imdb_id").agg(F.count("*").alias("n_lines"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.round(F.stddev_pop("n"), 6).alias("std_tokens"), F.round(F.avg((F.col("n") < 5).cast("double")), 6).alias("share_short"), rate("?").alias("questions"), rate("!").alias("exclamations"))


@query(
    f"""with {_WORDS}, c as (select w, count(*) as n from words group by 1), t as (select sum(n) as n from c), z as (select w, round(log10(1e9 * c.n / t.n), 6) as z from c, t),
cut as (select quantile_cont(z, 0.25) as q from z) select doc_id, round(avg(z.z), 4) as mean_zipf, round(avg((z.z <= q)::int), 6) as share_rare from words join z using (w), cut group by 1"""
)
def rare_words(spark: SparkSession, d: str) -> DataFrame:
    """Mean log frequency and share of rare words of each document; the frequencies and the cut-off are those of all documents."""
    w = _words(spark, d)
    counts = w.groupBy("w").agg(F.count("*").alias("n"))
    z = counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("w", F.round(F.log10(1e9 * F.col("n") / F.col("t")), 6).alias("z"))
    cut = quantiles(z, "z", {"q": 0.25})
    # counts per document first, so that a common word is joined once per document
    per = w.groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    return per.join(z, "w").join(F.broadcast(cut)).groupBy("doc_id").agg(F.round(F.sum(F.col("z") * F.col("c")) / F.sum("c"), 4).alias("mean_zipf"), F.round(F.sum(F.when(F.col("z") <= F.col("q"), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("share_rare"))


@query(
    f"""with {_WORDS}, k as (select * from words where w not in {_in(tx.STOP_WORDS)}) select doc_id, count(*) as n_words, """
    + ", ".join(f"round(avg((w in {_in(ws)})::int), 6) as {e}" for e, ws in tx.EMOTIONS.items())
    + " from k group by 1"
)
def emotion_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Shares of words of eight emotions in each document, without stop words; counted within the row."""
    kept = F.filter("toks", lambda w: ~w.isin(*tx.STOP_WORDS))
    rows = _docs(spark, d).select("doc_id", kept.alias("k")).where(F.size("k") > 0)
    share = lambda words: F.round(F.size(F.filter("k", lambda w: w.isin(*words))) / F.size("k"), 6)
    return rows.select("doc_id", F.size("k").cast("long").alias("n_words"), *[share(ws).alias(e) for e, ws in tx.EMOTIONS.items()])


@query()
def mtld(spark: SparkSession, d: str) -> DataFrame:
    """Lexical diversity of each document."""
    return sequence.with_mtld(_docs(spark, d), "doc_id", "toks")


_SCORES = "with v(w, s) as (values " + ", ".join(f"('{w}', {s})" for w, s in tx.VALENCE.items()) + f"), {UNITS_SQL}, lines as (select imdb_id, scene_id, unit_no, text from units where trim(text) <> '')"
_LINE = _SCORES + r", toks as (select imdb_id, scene_id, unit_no, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]*'), lambda x: lower(x))) as w from lines), got as (select imdb_id, scene_id, unit_no, sum(s) as s from toks join v using (w) group by 1, 2, 3), scored as (select l.imdb_id, l.scene_id, l.unit_no, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) as s from lines l left join got using (imdb_id, scene_id, unit_no))"


def _line_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = units(spark, d).where("trim(text) <> ''")
    total = F.aggregate(F.transform(tx.tokens(F.col("text")), lambda w: F.coalesce(tx.lookup(w, tx.VALENCE), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.select("imdb_id", "scene_id", "unit_no", F.round(total / F.sqrt(total * total + 15), 6).alias("s"))


@query(_LINE + " select imdb_id, count(*) as n, round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std, round(max(s) - min(s), 6) as range, round(avg((s = 0)::int), 6) as share_zero from scored where imdb_id is not null group by 1")
def sentiment_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the valence of the lines of each film."""
    # scores have six digits, so they are added up as whole millionths: a mean half way between two of them is rounded away from zero, whatever the order
    rows = _line_scores(spark, d).where("imdb_id is not null").withColumn("s6", F.round(F.col("s") * 1e6).cast("long"))
    out = sequence.series_aggregates(rows, "imdb_id", "s", F.round(F.sum("s6") / F.count("s6")) / 1e6)
    return out.select("imdb_id", "n", *[scalars.rounded(F.col(c), 6).alias(c) for c in ("mean", "std", "range", "share_zero")])


_SEQ = ", seq as (select imdb_id, row_number() over (partition by imdb_id order by scene_id, unit_no) - 1 as i, count(*) over (partition by imdb_id) as n, s from scored where imdb_id is not null)"


@query(
    _LINE + _SEQ + """, q as (select imdb_id, n, s, case when i < (n % 4) * (n // 4 + 1) then i // (n // 4 + 1) else (n % 4) + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) end as q from seq where n >= 4),
m as (select imdb_id, q, avg(s) as m, stddev_pop(s) as sd from q group by 1, 2), w as (select imdb_id, round(max(case when q = 0 then m end), 6) as q1, round(max(case when q = 1 then m end), 6) as q2, round(max(case when q = 2 then m end), 6) as q3, round(max(case when q = 3 then m end), 6) as q4, round(max(sd) - min(sd), 6) as std_range from m group by 1)
select * from (select distinct imdb_id from seq) left join w using (imdb_id)"""
)
def quartile_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Mean valence of the four quarters of each film's lines, and how their spread varies."""
    seq = sequence.numbered(_line_scores(spark, d).where("imdb_id is not null"), "imdb_id", ["unit_no"], "s", block="scene_id")
    out = sequence.quartiles(seq, "imdb_id")
    return out.select("imdb_id", *[scalars.rounded(F.col(c), 6).alias(c) for c in ("q1", "q2", "q3", "q4", "std_range")])


@query(
    """with e as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events where value is not null and user_id is not null),
g as (select user_id, j, sum(case when n = 1 then v else v * (1 - abs(j * (n - 1) / 19.0 - i)) end) as v from e, (select unnest(range(20)) as j) where n = 1 or abs(j * (n - 1) / 19.0 - i) < 1 group by 1, 2),
c as (select user_id, v, j / 19.0 as x, stddev_pop(v) over (partition by user_id) > 1e-12 as moves from g)
select user_id, """
    + ", ".join(f"case when bool_and(moves) then round(corr(v, {x}), 4) end as {n}" for n, x in (("rise", "x"), ("fall", "-x"), ("fall_rise", "cos(2 * pi() * x)"), ("rise_fall", "-cos(2 * pi() * x)"), ("rise_fall_rise", "-cos(4 * pi() * x)"), ("fall_rise_fall", "cos(4 * pi() * x)")))
    + " from c group by 1"
)
def arc_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Shape of each user's series of event values."""
    e = table(spark, d, "events").where("user_id is not null")
    seq = sequence.numbered(e.withColumn("day", F.to_date("ts")), "user_id", ["ts", "event_id"], "value", block="day")
    out = sequence.arc_similarity(sequence.resampled(seq, "user_id"), "user_id")
    return out.select("user_id", *[F.round(c, 4).alias(c) for c in sequence.ARCS])


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """(scene_id, heading, first, second): the scenes as the elements (kind, text) of two scenes of a script.

    Each unit becomes a character with a parenthetical and, if it has a text, a dialogue; every third unit is followed by a break
    and a dialogue without a character, every fourth goes on in a second dialogue, every fifth is followed by an element that is
    unknown. Scenes of four units or more are split in the middle.
    """
    rows = scenes(spark, d, "stage_direction", "dialogue_units")
    e = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.trim(F.coalesce(text, F.lit(""))).alias("text"))
    some = lambda c, *x: F.when(c, F.array(*x)).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    unit = lambda u, i: F.concat(
        F.array(e("character", u["speaker"]), e("aside", F.lit("beat"))), some(F.coalesce(F.trim(u["text"]), F.lit("")) != "", e("dialogue", u["text"])), some((i + 1) % 4 == 0, e("dialogue", F.lit("more"))),
        some((i + 1) % 3 == 0, e("heading", F.lit("cut")), e("dialogue", F.lit("voice"))), some((i + 1) % 5 == 0, e("transition", F.lit("x"))),
    )
    units_ = F.coalesce("dialogue_units", F.array().cast("array<struct<speaker:string,text:string>>"))
    made = rows.withColumn("n", F.size(units_)).withColumn("parts", F.transform(units_, lambda u, i: F.struct(i.alias("i"), unit(u, i).alias("e"))))
    half = F.when(F.col("n") >= 4, F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    side = lambda keep: F.flatten(F.transform(F.filter("parts", keep), lambda p: p["e"]))
    return made.select("scene_id", F.trim(F.coalesce("stage_direction", F.lit(""))).alias("heading"), side(lambda p: p["i"] < half).alias("first"), F.when(F.col("n") >= 4, side(lambda p: p["i"] >= half)).alias("second"))


def _markup(spark: SparkSession, d: str) -> DataFrame:
    """Scenes written as tagged scripts; characters that XML forbids are escaped."""
    tags = {"heading": "stage_direction", "aside": "parenthetical"}
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    tag = lambda k: F.when(k == "heading", tags["heading"]).when(k == "aside", tags["aside"]).otherwise(k)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<"), tag(x["kind"]), F.lit(">"), esc(x["text"]), F.lit("</"), tag(x["kind"]), F.lit(">"))), "")
    second = F.coalesce(F.concat(F.lit("<scene>"), text(F.col("second")), F.lit("</scene>")), F.lit(""))
    return _elements(spark, d).select("scene_id", F.concat(F.lit("<script><scene><stage_direction>"), esc(F.col("heading")), F.lit("</stage_direction>"), text(F.col("first")), F.lit("</scene>"), second, F.lit("</script>")).alias("xml"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The same scripts as nested records."""
    kind = lambda k: F.when(k == "heading", "action").when(k == "aside", "parenthetical").otherwise(k)
    made = lambda c: F.transform(c, lambda x: F.struct(kind(x["kind"]).alias("type"), F.when(x["kind"] != "character", x["text"]).alias("text"), F.when(x["kind"] == "character", x["text"]).alias("name")))
    scene = lambda h, c: F.struct(h.alias("heading"), made(F.col(c)).alias("elements"))
    return _elements(spark, d).select("scene_id", F.filter(F.array(scene(F.col("heading"), "first"), F.when(F.col("second").isNotNull(), scene(F.lit(""), "second"))), lambda x: x.isNotNull()).alias("scenes"))


_PLAYED = rf"""{SCENES_SQL}, n as (select scene_id, len(coalesce(dialogue_units, [])) as n, dialogue_units from once),
u as (select scene_id, n, unnest(dialogue_units) as u, generate_subscripts(dialogue_units, 1) as i from n where n > 0),
v as (select scene_id, i, case when n >= 4 and i > n // 2 then 2 else 1 end as scene_no, trim(coalesce(u.text, '')) as text, trim(coalesce(u.speaker, '')) as raw from u),
w as (select *, case when trim(regexp_replace(raw, '\s*\([^)]*\)\s*$', '')) = '' then raw else trim(regexp_replace(raw, '\s*\([^)]*\)\s*$', '')) end as name from v),
x as (select *, case when name = '' or regexp_matches(name, '[©®™]|^\d{{4}}|(?i:studios|pictures\s+inc|productions\s+llc)') then '' else name end as who from w),
l as (select scene_id, scene_no, i, 1 as k, who as speaker, text from x where text <> '' union all select scene_id, scene_no, i, 2, who, 'more' from x where i % 4 = 0
  union all select scene_id, scene_no, i, 3, who, '' from x where text = '' and i % 4 <> 0 and who <> '' union all select scene_id, scene_no, i, 4, '', 'voice' from x where i % 3 = 0),
lines as (select scene_id, scene_no, (row_number() over (partition by scene_id, scene_no order by i, k))::int as line_no, speaker, text, k from l),
warns as (select scene_id, count(*) as n from (select scene_id from lines where speaker = '' union all select scene_id from x where who = '' union all select scene_id from lines where k = 3
  union all select scene_id from (select distinct scene_id, scene_no from x where i % 5 = 0)) group by 1)"""
_STRUCTURE = f"""with {_PLAYED}, g as (select scene_id, count(*) as n_lines, count(distinct case when speaker <> '' and text <> '' then speaker end) as n_speakers, sum(length(text))::bigint as dialogue_chars from lines group by 1)
select n.scene_id, (case when n.n >= 4 then 2 else 1 end)::bigint as n_scenes, coalesce(n_lines, 0) as n_lines, coalesce(n_speakers, 0) as n_speakers, coalesce(dialogue_chars, 0) as dialogue_chars, coalesce(warns.n, 0) as n_warnings
from n left join g using (scene_id) left join warns using (scene_id)"""
_LINES = f"with {_PLAYED} select scene_id, scene_no::int as scene_no, line_no, speaker, text from lines"


def _structure(parsed: DataFrame) -> DataFrame:
    return screenplay.structure(parsed, "scene_id").select("scene_id", "n_scenes", "n_lines", "n_speakers", "dialogue_chars", "n_warnings")


def _lines_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'line'").select("scene_id", "scene_no", "line_no", "speaker", "text")


@query(_STRUCTURE)
def structure_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Structural measures of tagged scripts: the scenes are written as markup and read again."""
    return _structure(screenplay.parse_scripts(_markup(spark, d), "scene_id", "xml"))


@query(_LINES)
def speaker_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the tagged scripts with their speakers."""
    return _lines_of(screenplay.parse_scripts(_markup(spark, d), "scene_id", "xml"))


@query(_STRUCTURE)
def record_structure(spark: SparkSession, d: str) -> DataFrame:
    """The same measures of the scripts as nested records."""
    return _structure(screenplay.parse_records(_records(spark, d), "scene_id", "scenes"))


@query(_LINES)
def record_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the nested records with their speakers."""
    return _lines_of(screenplay.parse_records(_records(spark, d), "scene_id", "scenes"))


@query(
    f"""with {UNITS_SQL}, r as (select imdb_id, scene_id, speaker, text from units where text <> '' and imdb_id is not null), p as (select imdb_id, scene_id, count(*) as n_lines, sum(length(text))::bigint as n_chars from r group by 1, 2),
cast_ as (select distinct imdb_id, scene_id, speaker from r where speaker <> ''), sp as (select imdb_id, speaker, count(*) as n, min(scene_id) as scene_id from cast_ group by 1, 2), o as (select imdb_id, scene_id, count(*) as only_here from sp where n = 1 group by 1, 2),
t as (select imdb_id, sum(n_lines)::bigint as al, sum(n_chars)::bigint as ac from p group by 1), s as (select imdb_id, count(*) as asp from sp group by 1)
select imdb_id, scene_id, n_lines, n_chars, al - n_lines as lines_without, ac - n_chars as chars_without, coalesce(asp, 0) - coalesce(only_here, 0) as speakers_without from p join t using (imdb_id) left join s using (imdb_id) left join o using (imdb_id, scene_id)"""
)
def scene_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What each film would have without one of its scenes."""
    return screenplay.scene_contributions(units(spark, d).where("imdb_id is not null"), "imdb_id", "scene_id", "speaker", "text")


_NODES = f"{UNITS_SQL}, who as (select imdb_id, scene_id, speaker from units where speaker <> '' and imdb_id is not null), nodes as (select imdb_id, speaker, count(*) as n_lines from who group by 1, 2 having count(*) >= 5)"
_EDGES = ", here as (select distinct imdb_id, scene_id, speaker from who where (imdb_id, speaker) in (select (imdb_id, speaker) from nodes)), edges as (select a.imdb_id, a.speaker as a, b.speaker as b, count(*) as weight from here a join here b on a.imdb_id = b.imdb_id and a.scene_id = b.scene_id and a.speaker < b.speaker group by 1, 2, 3)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = units(spark, d).where("speaker <> '' and imdb_id is not null")
    nodes = graph.significant(u, "imdb_id", "speaker")
    return nodes, graph.edges(u, nodes, "imdb_id", "scene_id", "speaker")


@query(f"with {_NODES} select imdb_id, speaker, n_lines from nodes")
def significant_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Speakers with at least five lines."""
    return _graph(spark, d)[0]


@query(f"with {_NODES}{_EDGES} select imdb_id, a, b, weight from edges")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Speakers who share scenes."""
    return _graph(spark, d)[1]


@query(f"with {_NODES}{_EDGES}, n as (select imdb_id, count(*) as n_nodes from nodes group by 1), e as (select imdb_id, count(*) as n_edges, avg(weight) as w from edges group by 1) select imdb_id, n_nodes, coalesce(n_edges, 0) as n_edges, round(w, 6) as mean_weight, case when n_nodes > 1 then round(2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)), 6) end as density from n left join e using (imdb_id)")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    """Density of each film's graph."""
    return graph.density(*_graph(spark, d), "imdb_id").select("imdb_id", "n_nodes", "n_edges", *[scalars.rounded(F.col(c), 6).alias(c) for c in ("mean_weight", "density")])


@query(
    f"""with {_NODES}, r as (select imdb_id, n_lines, row_number() over (partition by imdb_id order by n_lines, speaker) as up, row_number() over (partition by imdb_id order by n_lines desc, speaker) as dn, count(*) over (partition by imdb_id) as n from nodes),
b as (select imdb_id, max(case when dn = ceil(n * 0.1) then n_lines end) as bar from r group by 1)
select imdb_id, count(*) as n_nodes, round((2.0 * sum(up * n_lines) - (count(*) + 1) * sum(n_lines)) / (count(*) * sum(n_lines)), 6) as gini, round(max(n_lines) / sum(n_lines), 6) as top1_share, round(sum(case when dn <= 3 then n_lines end) / sum(n_lines), 6) as top3_share, count_if(n_lines >= bar)::bigint as n_leads from r join b using (imdb_id) group by 1"""
)
def gini_and_shares(spark: SparkSession, d: str) -> DataFrame:
    """How lines are shared among the cast."""
    nodes, _ = _graph(spark, d)
    out = graph.node_measures(nodes, "imdb_id", "speaker")
    return out.select("imdb_id", "n_nodes", "n_leads", *[scalars.rounded(F.col(c), 6).alias(c) for c in ("gini", "top1_share", "top3_share")])


@query(
    f"""with {_NODES}{_EDGES}, both_ as (select imdb_id, a as u, b as v from edges union all select imdb_id, b, a from edges), deg as (select imdb_id, u, count(*) as d from both_ group by 1, 2),
tri as (select e.imdb_id, x.v as u, count(*) as t from edges e join both_ x on x.imdb_id = e.imdb_id and x.u = e.a join both_ y on y.imdb_id = e.imdb_id and y.u = e.b and y.v = x.v group by 1, 2),
l as (select n.imdb_id, case when d > 1 then 2.0 * coalesce(t, 0) / (d * (d - 1)) else 0.0 end as c from nodes n left join deg on deg.imdb_id = n.imdb_id and deg.u = n.speaker left join tri on tri.imdb_id = n.imdb_id and tri.u = n.speaker)
select imdb_id, case when count(*) >= 3 then round(avg(c), 6) end as clustering from l group by 1"""
)
def graph_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Mean local clustering of each film's graph."""
    return graph.clustering(*_graph(spark, d), "imdb_id", "speaker").select("imdb_id", scalars.rounded(F.col("clustering"), 6).alias("clustering"))


@query()
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Components, diameter, betweenness, modularity and centrality of each film's graph."""
    return graph.path_measures(*_graph(spark, d), "imdb_id", "speaker")


@query("with p as (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings), m as (select label, i, avg(x) as m from p group by 1, 2) select label, i::int as at, round(m, 6) as m from m")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label, in long form."""
    pooled = vector.mean_pool(table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("vector").alias("at", "m")).select("label", "at", F.round("m", 6).alias("m"))


@query(
    """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), r as (select vec_id, embedding::double[] as e from embeddings), d as (select q.vec_id as query, r.vec_id as neighbour, round(list_distance(q.e, r.e), 6) as distance from q, r where q.vec_id <> r.vec_id),
k as (select *, row_number() over (partition by query order by distance, neighbour) as place from d) select query, place::int as place, distance from k where place <= 5"""
)
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    return vector.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("query", "place", F.round("distance", 6).alias("distance"))


@query()
def pca_project(spark: SparkSession, d: str) -> DataFrame:
    """32 principal components, fitted on all vectors."""
    e = table(spark, d, "embeddings")
    return vector.pca(e, e, "vec_id", "embedding", 32)


@query()
def topic_lda(spark: SparkSession, d: str) -> DataFrame:
    """Topic shares of every document; the model is fitted on the documents of training films."""
    docs = table(spark, d, "documents").select("doc_id", "imdb_id", "text").where("text is not null").withColumn("toks", tx.tokens(F.col("text")))
    train = docs.join(table(spark, d, "split_assignments").where("split = 'train'").select("imdb_id"), "imdb_id", "left_semi")
    return topics(train, docs, "doc_id", "toks", 20, iterations=10)[0]


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, by the plan the stream uses."""
    out = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_FILM_LEXICAL = f"""with {UNITS_SQL}, l as (select imdb_id, text, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*'), lambda x: lower(x)) as toks from units where trim(text) <> '' and imdb_id is not null),
w as (select imdb_id, unnest(toks) as w from l), c as (select imdb_id, w, count(*) as n from w group by 1, 2),
h as (select imdb_id, sum(n)::bigint as n_tokens, count(*) as n_types, round(avg((n = 1)::int), 6) as hapax_ratio, round(sum(case when w in {_FIRST} then n else 0 end) / (sum(case when w in {_SECOND} then n else 0 end) + 1.0), 6) as pronoun_ratio from c group by 1),
g as (select imdb_id, count(*) as n_lines, round(avg(len(toks)), 6) as mean_tokens, round(stddev_pop(len(toks)), 6) as std_tokens, round(avg((len(toks) < 5)::int), 6) as share_short,
  round(1000.0 * sum(length(text) - length(replace(text, '?', ''))) / greatest(sum(len(toks)), 1), 4) as questions, round(1000.0 * sum(length(text) - length(replace(text, '!', ''))) / greatest(sum(len(toks)), 1), 4) as exclamations from l group by 1)
select g.*, coalesce(n_tokens, 0) as n_tokens, coalesce(n_types, 0) as n_types, hapax_ratio, pronoun_ratio from g left join h using (imdb_id)"""


@query(_FILM_LEXICAL)
def film_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Lexical features of each film: lines, lengths, punctuation, types, hapaxes and pronouns, from counts by film and word."""
    lines = units(spark, d).where("trim(text) <> '' and imdb_id is not null").select("imdb_id", "text", tx.tokens(F.col("text")).alias("toks"))
    n = F.size("toks")
    rate = lambda m: scalars.rounded(1000.0 * F.sum(tx.count_of(F.col("text"), m)) / F.greatest(F.sum(n), F.lit(1)), 4)
    per_line = lines.groupBy("imdb_id").agg(F.count("*").alias("n_lines"), scalars.rounded(F.avg(n), 6).alias("mean_tokens"), scalars.rounded(F.stddev_pop(n), 6).alias("std_tokens"), scalars.rounded(F.avg((n < 5).cast("double")), 6).alias("share_short"), rate("?").alias("questions"), rate("!").alias("exclamations"))
    counts = lines.select("imdb_id", F.explode_outer("toks").alias("w")).where("w is not null").groupBy("imdb_id", "w").agg(F.count("*").alias("n"))
    of = lambda words: F.sum(F.when(F.col("w").isin(*words), F.col("n")).otherwise(0))
    per_word = counts.groupBy("imdb_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), scalars.rounded(F.avg((F.col("n") == 1).cast("double")), 6).alias("hapax_ratio"), scalars.rounded(of(tx.FIRST_PERSON) / (of(tx.SECOND_PERSON) + 1.0), 6).alias("pronoun_ratio"))
    return per_line.join(per_word, "imdb_id", "left").na.fill(0, ["n_tokens", "n_types"])


@query()
def film_mtld(spark: SparkSession, d: str) -> DataFrame:
    """Lexical diversity over all words of each film in order, streamed through sorted partitions."""
    lines = units(spark, d).where("trim(text) <> '' and imdb_id is not null").select("imdb_id", "scene_id", "unit_no", tx.tokens(F.col("text")).alias("toks"))
    return sequence.ordered_mtld(lines, "imdb_id", ["scene_id", "unit_no"], "toks")


_MOOD = {"n": "n_scored", "mean": "mood_mean", "std": "mood_std", "range": "mood_range", "share_zero": "mood_zero"}


def film_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Moments and trajectory of the valence of each film's lines."""
    return sentiment_aggregates(spark, d).withColumnsRenamed(_MOOD).join(quartile_trajectory(spark, d).withColumnRenamed("std_range", "mood_std_range"), "imdb_id", "left")


_FILM_SENTIMENT = f"select a.imdb_id, {', '.join(f'{o} as {n}' for o, n in _MOOD.items())}, q1, q2, q3, q4, std_range as mood_std_range from ({query.sql['sentiment_aggregates']}) a left join ({query.sql['quartile_trajectory']}) b using (imdb_id)"
query(_FILM_SENTIMENT)(film_sentiment)


def film_network(spark: SparkSession, d: str) -> DataFrame:
    """Density, shares and clustering of each film's graph; films whose scenes lost their bounds have no graph (`flagged`)."""
    lost = units(spark, d).where("imdb_id is not null").groupBy("imdb_id").agg(F.count_distinct("scene_id").alias("s"), F.sum(F.length("text")).alias("c")).select("imdb_id", scalars.quality_flag(F.col("s"), F.col("c"), 5, 2000).alias("flagged"))
    wide = graph_density(spark, d).join(gini_and_shares(spark, d).drop("n_nodes"), "imdb_id", "left").join(graph_clustering(spark, d), "imdb_id", "left").join(lost, "imdb_id")
    return wide.select("imdb_id", "flagged", *[F.when(~F.col("flagged"), F.col(c)).alias(c) for c in wide.columns if c not in ("imdb_id", "flagged")])


_NETWORK = ("n_nodes", "n_edges", "mean_weight", "density", "n_leads", "gini", "top1_share", "top3_share", "clustering")
_FILM_NETWORK = f"""with {UNITS_SQL}, lost as (select imdb_id, coalesce(count(distinct scene_id) < 5 and sum(length(text)) > 2000, false) as flagged from units where imdb_id is not null group by 1),
a as (select * from ({query.sql['graph_density']})), b as (select * exclude (n_nodes) from ({query.sql['gini_and_shares']})), c as (select * from ({query.sql['graph_clustering']}))
select imdb_id, flagged, {', '.join(f'case when not flagged then {x} end as {x}' for x in _NETWORK)} from a left join b using (imdb_id) left join c using (imdb_id) join lost using (imdb_id)"""
query(_FILM_NETWORK)(film_network)


def film_features(spark: SparkSession, d: str) -> DataFrame:
    """All features of a film side by side; films that lack a group have nulls there and `has_network` tells of the graph.

    Each group, a row a film, is written to the checkpoint folder: one plan of them all is more than a small driver holds.
    """
    lexical, mood, network = (cut(f(spark, d)) for f in (film_lexical, film_sentiment, film_network))
    wide = lexical.join(mood, "imdb_id", "full").join(network, "imdb_id", "full")
    return wide.withColumn("has_network", F.col("n_nodes").isNotNull()).na.fill(False, ["flagged"])


query(f"select * replace (coalesce(flagged, false) as flagged), n_nodes is not null as has_network from ({_FILM_LEXICAL}) a full join ({_FILM_SENTIMENT}) b using (imdb_id) full join ({_FILM_NETWORK}) c using (imdb_id)")(film_features)


@query(
    f"""with {SCENES_SQL}, h as (select scene_id, trim(replace(case when stage_direction <> '' then stage_direction when scene_description <> '' then scene_description else '' end, chr(10), ' ')) as h, stage_direction as sd, scene_description as de, dialogue_units as u from once)
select scene_id, substr(case when h <> '' then h when len(u) > 0 then coalesce(u[1].speaker, '') || ': ' || substr(coalesce(u[1].text, ''), 1, 60) else '' end, 1, 80) as heading,
concat_ws(' ', nullif(trim(sd), ''), nullif(trim(de), '')) as action, trim(replace(substr(coalesce(de, ''), 1, 40), chr(10), ' ⏎ ')) as head, trim(replace(right(coalesce(de, ''), 40), chr(10), ' ⏎ ')) as tail from h"""
)
def scene_headings(spark: SparkSession, d: str) -> DataFrame:
    """One line that names each scene, its action text, and the beginning and end of its description on one line."""
    rows = scenes(spark, d, "stage_direction", "scene_description", "dialogue_units")
    return rows.select(
        "scene_id", tx.scene_heading(F.col("stage_direction"), F.col("scene_description"), F.col("dialogue_units")).alias("heading"), tx.action_text(F.col("stage_direction"), F.col("scene_description")).alias("action"),
        tx.chunk(F.col("scene_description"), 40).alias("head"), tx.chunk(F.col("scene_description"), 40, tail=True).alias("tail"),
    )


@query()
def valence_rules(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the valence of each film's lines by lexicon and rules: negations, degrees, capitals, punctuation."""
    lines = units(spark, d).where("trim(text) <> '' and imdb_id is not null").select("imdb_id", "text")
    return sequence.series_aggregates(valence.with_valence(lines, "text", tx.VALENCE), "imdb_id", "valence")
