"""Tagged screenplays as ordered tables of scenes and dialogue lines, and structural measures of them.

A script is one XML text with <scene> elements holding <stage_direction>, <scene_description>, <character>,
<parenthetical> and <dialogue>. Each script is read once, in Arrow batches; a malformed, empty or null one gives a warning and
no lines, never an error.

The same content comes as nested records, too: scenes with a heading and elements of a type (action, character, dialogue,
parenthetical). Both are brought to the same events and read by one state machine.

Who speaks: a dialogue belongs to the last plausible character since the last break, a break being a stage direction, a
description, an action or an implausible character. Parentheticals and unknown elements are transparent. Without a speaker the
line has '' for one. A plausible character that is followed by no dialogue before the next break or character leaves a line
with an empty text, which counts as a line but names no speaker. There is a warning for each line without a speaker, each
implausible character, each character without dialogue, and each kind of unknown element in a scene.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_A_NAME

_REJECT = [re.compile(x) for x in NOT_A_NAME]
LINES = "kind string, scene_no int, line_no int, speaker string, text string, stage_direction string, scene_description string, warning string"


def _name(raw: str) -> str:
    bare = re.sub(r"\s*\([^)]*\)\s*$", "", raw).strip()
    return bare or raw.strip()


def attribute(events: Iterator[tuple[str, str]]) -> tuple[list[str], list[str], list[tuple[str, str]], list[str]]:
    """(headings, descriptions, lines with speakers, warnings) of the events of one scene: (kind, text) with the kinds heading,
    description, character, dialogue, aside; any other is unknown."""
    headings, described, lines, warnings, unknown = [], [], [], [], set()
    speaker, pending = "", False

    def flush() -> None:
        nonlocal pending
        if pending:
            lines.append((speaker, ""))
            warnings.append(f"character without dialogue: {speaker}")
        pending = False

    for kind, text in events:
        if kind in ("heading", "description"):
            flush()
            speaker = ""
            (headings if kind == "heading" else described).append(text)
        elif kind == "character":
            flush()
            name = _name(text)
            ok = bool(name) and not any(r.search(name) for r in _REJECT)
            speaker, pending = (name, True) if ok else ("", False)
            if not ok:
                warnings.append(f"implausible character: {text}")
        elif kind == "dialogue":
            pending = False
            lines.append((speaker, text))
            if not speaker:
                warnings.append("dialogue without a speaker")
        elif kind != "aside" and kind not in unknown:
            unknown.add(kind)
            warnings.append(f"unknown element: {kind}")
    flush()
    return headings, described, lines, warnings


def _scene_rows(no: int, events: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    headings, described, lines, warnings = attribute(events)
    yield ("scene", no, None, None, None, " ".join(h for h in headings if h), " ".join(d for d in described if d), None)
    for k, (who, text) in enumerate(lines, 1):
        yield ("line", no, k, who, text, None, None, None)
    for w in warnings:
        yield _warning(w, no)


def _warning(text: str, scene: int | None = None) -> tuple:
    return ("warning", scene, None, None, None, None, None, text)


_TAGS = {"stage_direction": "heading", "scene_description": "description", "character": "character", "dialogue": "dialogue", "parenthetical": "aside"}
_TYPES = {"action": "description", "character": "character", "dialogue": "dialogue", "parenthetical": "aside"}


def read_script(xml: str | None) -> Iterator[tuple]:
    """Rows of LINES: one 'scene' row per scene, its 'line' rows, and 'warning' rows."""
    if xml is None or not xml.strip():
        yield _warning("empty script")
        return
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        yield _warning("malformed script")
        return
    if root.tag != "script":
        yield _warning(f"unexpected root {root.tag}")
    found = list(root.iter("scene"))
    if not found:
        yield _warning("no scenes")
    for no, scene in enumerate(found, 1):
        yield from _scene_rows(no, ((_TAGS.get(e.tag, e.tag), "".join(e.itertext()).strip()) for e in scene))


def read_record(scenes: list | None) -> Iterator[tuple]:
    """Rows of LINES of the scenes of a nested record: mappings with `heading` and `elements` (type, text, name)."""
    if scenes is None or not len(scenes):
        yield _warning("no scenes")
        return
    clean = lambda x: (x or "").strip()
    for no, scene in enumerate(scenes, 1):
        elements = (scene or {}).get("elements")
        kinds = [(_TYPES.get(e["type"], str(e["type"])), clean(e["name"] if e["type"] == "character" else e["text"])) for e in (elements if elements is not None else []) if e is not None]
        yield from _scene_rows(no, iter([("heading", clean((scene or {}).get("heading"))), *kinds]))


def parse_scripts(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, rows of LINES). Repeated keys are read each for itself."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, x in zip(pdf[key], pdf[xml]) for r in read_script(x)]
            out = pd.DataFrame(rows, columns=[key, *names])
            yield out.astype({"scene_no": "Int32", "line_no": "Int32"})

    return df.select(key, xml).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {LINES}")


def parse_records(df: DataFrame, key: str, scenes: str) -> DataFrame:
    """(key, rows of LINES) of nested records with an array of scenes (heading, elements of type, text and name)."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, x in zip(pdf[key], pdf[scenes]) for r in read_record(x)]
            yield pd.DataFrame(rows, columns=[key, *names]).astype({"scene_no": "Int32", "line_no": "Int32"})

    return df.select(key, scenes).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {LINES}")


def structure(parsed: DataFrame, key: str) -> DataFrame:
    """(key, n_scenes, n_lines, n_speakers, dialogue_chars, description_chars, lines_per_scene, chars_per_line, n_warnings) of parsed scripts."""
    line, scene = F.col("kind") == "line", F.col("kind") == "scene"
    out = parsed.groupBy(key).agg(
        F.count_if(scene).alias("n_scenes"),
        F.count_if(line).alias("n_lines"),
        F.count_distinct(F.when(line & (F.col("speaker") != "") & (F.col("text") != ""), F.col("speaker"))).alias("n_speakers"),
        F.coalesce(F.sum(F.when(line, F.length("text"))), F.lit(0)).alias("dialogue_chars"),
        F.coalesce(F.sum(F.when(scene, F.length("scene_description"))), F.lit(0)).alias("description_chars"),
        F.count_if(F.col("kind") == "warning").alias("n_warnings"),
    )
    return out.withColumn("lines_per_scene", F.try_divide("n_lines", "n_scenes")).withColumn("chars_per_line", F.col("dialogue_chars") / F.greatest("n_lines", F.lit(1)))


def scene_contributions(units: DataFrame, film: str, scene: str, speaker: str, text: str) -> DataFrame:
    """(film, scene, n_lines, n_chars, n_speakers and each of them without the scene).

    Leave-one-out without recomputing: sums subtract the scene's part; a speaker is lost only with the one scene they speak in.
    """
    rows = units.where(F.col(text).isNotNull() & (F.col(text) != ""))
    per = rows.groupBy(film, scene).agg(F.count("*").alias("n_lines"), F.sum(F.length(text)).alias("n_chars"))
    cast = rows.where(F.col(speaker).isNotNull() & (F.col(speaker) != "")).select(film, scene, speaker).distinct()
    spread = cast.groupBy(film, speaker).agg(F.count("*").alias("n"), F.min(scene).alias(scene))
    only_here = spread.where("n = 1").groupBy(film, scene).agg(F.count("*").alias("only_here"))
    total = per.groupBy(film).agg(F.sum("n_lines").alias("all_lines"), F.sum("n_chars").alias("all_chars"))
    speakers = spread.groupBy(film).agg(F.count("*").alias("all_speakers"))
    joined = per.join(total, film).join(speakers, film, "left").join(only_here, [film, scene], "left").na.fill(0, ["only_here", "all_speakers"])
    return joined.select(
        film, scene, "n_lines", "n_chars", (F.col("all_lines") - F.col("n_lines")).alias("lines_without"), (F.col("all_chars") - F.col("n_chars")).alias("chars_without"), (F.col("all_speakers") - F.col("only_here")).alias("speakers_without")
    )
