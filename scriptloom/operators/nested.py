"""Problem 5: deeply nested JSON records as related flat tables.

1. Each record is stream-parsed: tokens drive an explicit stack, so depth has no bound, and triples are emitted as the tokens
   come: the path with its list positions replaced by `[]`, the value, and the ordinals, i.e. the place in reading order within
   every repeated ancestor. Only what is below one `dialogue_units` is held as a tree, as the last key of an object may be the
   one that makes it a unit. A record that turns out to be no valid JSON at any place gives none.
2. Paths are grouped by their repeated ancestor. The same content may be nested in more than one way (scenes below acts, below
   a wrapper, or as JSON in a string; units as objects, as pairs, alone without a list, in dual columns), so paths of one
   meaning fall to the same ancestor: record, scene or unit.
3. Each group is pivoted into one table, whose rows carry the key of their parent and their place in it.

Rules of the reading: null entries take no number. A scene is every non-null entry of a `scenes` list, in reading order over
the whole record. A unit is an object below `dialogue_units` with a speaker or a text, a list of one or two strings
(speaker, text), or a string by itself (text); other objects and lists there are containers. Further fields of a unit belong to
it, whatever they hold. Of keys that an object holds twice, all values count, in reading order (of a unit's, the last one).
Payloads that are not valid JSON objects or lists give no rows; of several deliveries of a record the last valid one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import JSONDecoder, scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import keep_one, split_repeated

TRIPLES = "record_id long, path string, value string, scene_pos int, unit_pos int, seq int"

SCENE_LISTS = ("scenes",)
UNIT_LISTS = ("dialogue_units",)
SPEAKER, TEXT = "speaker", "text"

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![A-Za-z0-9_.+\-])")


class Number(str):
    """A number as it is written, so it is never rounded. Strings are plain `str`, booleans and null as in Python."""


_NAMED = {"null": None, "true": True, "false": False}


def _refuse(name: str) -> None:
    raise ValueError(name)


_scan = JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse).scan_once


def value_at(text: str, at: int) -> tuple[object, int]:
    """The value that begins at a place, and where it ends: by the library's scanner, or, where that would nest too deep for it, by the
    explicit stack of `tree_at`, which gives the same."""
    try:
        return _scan(text, at)
    except RecursionError:
        return tree_at(text, at)
    except StopIteration as e:
        raise ValueError(at) from e


def _scalar_at(text: str, at: int) -> tuple[str | bool | None, int]:
    """A string, number, boolean or null, and where it ends."""
    if text[at] == '"':
        return scanstring(text, at + 1, True)
    found = _SCALAR.match(text, at)
    if not found:
        raise ValueError(at)
    return _NAMED[found[0]] if found[0] in _NAMED else Number(found[0]), found.end()


def _key_at(text: str, at: int) -> tuple[str, int]:
    """A key, and where its value begins."""
    if text[at] != '"':
        raise ValueError(at)
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at] != ":":
        raise ValueError(at)
    return key, _SPACE.match(text, at + 1).end()


def _next(text: str, at: int, close: str, first: bool) -> int:
    """Where the next member of a container begins; -1 - end where the container closes."""
    at = _SPACE.match(text, at).end()
    if text[at] == close:
        return -2 - at
    if not first:
        if text[at] != ",":
            raise ValueError(at)
        at = _SPACE.match(text, at + 1).end()
        if text[at] == close:
            raise ValueError(at)
    return at


def tree_at(text: str, at: int) -> tuple[object, int]:
    """The value that begins at a place, as dictionaries and lists, and where it ends. No bound on the depth."""
    if text[at] not in "[{":
        return _scalar_at(text, at)
    root: dict | list = {} if text[at] == "{" else []
    stack, at, first = [root], at + 1, True
    while stack:
        own = stack[-1]
        at = _next(text, at, "}" if isinstance(own, dict) else "]", first)
        if at < 0:
            stack.pop()
            at, first = -1 - at, False
            continue
        key = None
        if isinstance(own, dict):
            key, at = _key_at(text, at)
        first = text[at] in "[{"
        if first:
            value: object = {} if text[at] == "{" else []
            stack.append(value)  # type: ignore[arg-type]
            at += 1
        else:
            value, at = _scalar_at(text, at)
        if isinstance(own, dict):
            own[key] = value
        else:
            own.append(value)
    return root, at


def loads(text: str | None) -> dict | list | None:
    """The JSON value, or None where the text is no strict JSON container."""
    try:
        at = _SPACE.match(text, 0).end() if text else 0
        if not text or text[at] not in "[{":
            return None
        value, at = value_at(text, at)
        return value if _SPACE.match(text, at).end() == len(text) else None
    except (IndexError, ValueError):
        return None


def _text(value: str | bool) -> str:
    """A leaf as text, numbers and booleans as JSON writes them; halves of surrogate pairs, which JSON may escape but UTF-8 can't hold, become replacement characters."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


Triple = tuple[str, str | None, int, int]
#: What a container is part of: the record, the list of scenes, one scene, something within a scene.
_TOP, _SCENES, _SCENE, _WITHIN = range(4)


class _Reader:
    """Reads one record into triples; `units` holds how many units each scene has so far."""

    def __init__(self) -> None:
        self.out: list[Triple] = []
        self.units: list[int] = [0]

    def scene(self, path: str) -> int:
        self.units.append(0)
        self.out.append((_text(path), None, len(self.units) - 1, 0))
        return len(self.units) - 1

    def leaf(self, path: str, value: str | bool | None, scene: int, unit: int) -> None:
        if value is not None:
            self.out.append((_text(path), _text(value), scene, unit))

    def leaves(self, path: str, value: object, scene: int, unit: int) -> None:
        """All scalars of a tree."""
        todo = [(path, value)]
        while todo:
            at, v = todo.pop()
            if isinstance(v, dict):
                todo += [(f"{at}.{k}", x) for k, x in reversed(v.items())]
            elif isinstance(v, list):
                todo += [(at + "[]", x) for x in reversed(v)]
            else:
                self.leaf(at, v, scene, unit)

    def unit(self, path: str, value: object, scene: int) -> None:
        self.units[scene] += 1
        self.out.append((_text(path), None, scene, self.units[scene]))
        self.leaves(path, value, scene, self.units[scene])

    def dialogue(self, path: str, value: object, scene: int) -> None:
        """The units of a tree below `dialogue_units`, in reading order."""
        if type(value) is str and (opened := _opened(value)) is not None:
            value = opened
        todo = [(path, value)]
        while todo:
            at, v = todo.pop()
            if isinstance(v, dict):
                if SPEAKER in v or TEXT in v:
                    self.unit(at, v, scene)
                else:
                    todo += [(f"{at}.{k}", x) for k, x in reversed(v.items()) if isinstance(x, dict | list)]
            elif isinstance(v, list):
                if 1 <= len(v) <= 2 and any(type(x) is str for x in v) and all(x is None or type(x) is str for x in v):
                    self.unit(at, {SPEAKER: v[0], TEXT: v[1]} if len(v) == 2 else {TEXT: v[0]}, scene)
                else:
                    todo += [(at + "[]", x) for x in reversed(v)]
            elif type(v) is str:
                self.unit(at, {TEXT: v}, scene)

    def read(self, text: str, path: str, kind: int) -> None:
        """Reads a text that holds one container, part of `kind`. Raises ValueError or IndexError where it is no strict JSON."""
        at = _SPACE.match(text, 0).end()
        if text[at] not in "[{":
            raise ValueError(at)
        scene = 0
        if kind == _SCENES and text[at] == "{":
            path += "[]"
            kind, scene = _SCENE, self.scene(path)
        # (closing mark, kind, scene) and the step of the path of every container that is open; paths are joined where they are emitted
        stack, steps, at, first = [("}" if text[at] == "{" else "]", kind, scene)], [path], at + 1, True
        while stack:
            close, kind, scene = stack[-1]
            at = _next(text, at, close, first)
            if at < 0:
                stack.pop()
                steps.pop()
                at, first = -1 - at, False
                continue
            first, step, scenes = False, "[]", False
            if close == "}":
                key, at = _key_at(text, at)
                step = "." + key
                if kind in (_SCENE, _WITHIN) and key in UNIT_LISTS:
                    value, at = value_at(text, at)
                    self.dialogue("".join(steps) + step, value, scene)
                    continue
                scenes = kind in (_TOP, _SCENE) and key in SCENE_LISTS
            c = text[at]
            if scenes and c == '"':
                value, at = _scalar_at(text, at)
                self.scenes_in_text("".join(steps) + step, value)
            elif c not in "[{":
                value, at = _scalar_at(text, at)
                if value is None:
                    continue
                if kind == _SCENES or scenes:
                    # an entry without fields, or one scene that is no list
                    where = "".join(steps) + step + ("[]" if scenes else "")
                    self.leaf(where, value, self.scene(where), 0)
                else:
                    self.leaf("".join(steps) + step, value, scene, 0)
            else:
                inside = _TOP if kind == _TOP else _WITHIN
                if kind == _SCENES or scenes and c == "{":
                    step += "[]" if scenes else ""
                    inside, scene = _SCENE if c == "{" else _WITHIN, self.scene("".join(steps) + step)
                elif scenes:
                    inside, scene = _SCENES, 0
                stack.append(("}" if c == "{" else "]", inside, scene))
                steps.append(step)
                at, first = at + 1, True
        if _SPACE.match(text, at).end() != len(text):
            raise ValueError(at)

    def scenes_in_text(self, path: str, value: str) -> None:
        """Scenes held as JSON in a string; a string that is none is one scene by itself. Each level of strings within strings
        doubles the marks of escape, so they are never deep."""
        had, units = len(self.out), len(self.units)
        try:
            self.read(value, path, _SCENES)
        except (IndexError, ValueError):
            del self.out[had:], self.units[units:]
            self.leaf(path + "[]", value, self.scene(path + "[]"), 0)


def _opened(value: str) -> dict | list | None:
    """JSON that is held in a string."""
    return loads(value) if value.lstrip()[:1] in ("[", "{") else None


def triples(payload: str | None) -> list[Triple] | None:
    """(path, value, scene_pos, unit_pos) of every leaf and every repeated entry; 0 stands for no such ancestor. None where the
    payload is no strict JSON container.

    A repeated entry gives its own path with a null value first, so entries without fields are kept.
    """
    reader = _Reader()
    try:
        reader.read(payload or "", "$", _TOP)
    except (IndexError, ValueError):
        return None
    return reader.out


def _is_valid(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: loads(p) is not None).astype(bool)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Triples of each readable record, the first one (seq -1, no path) for the record itself."""
    names = [c.split()[0] for c in TRIPLES.split(", ")]
    for pdf in batches:
        rows = []
        for record, payload in zip(pdf["record_id"], pdf["payload"]):
            found = triples(payload)
            if found is not None:
                rows.append((record, None, None, 0, 0, -1))
                rows += [(record, *t, i) for i, t in enumerate(found)]
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def last_deliveries(records: DataFrame) -> DataFrame:
    """(record_id, payload, loaded_at) with each record once: the only delivery, readable or not, or the last readable one of several.

    Only records delivered several times are read for that and shuffled; null keys and payloads are left out.
    """
    rows = records.select("record_id", "payload", "loaded_at").where("record_id is not null and payload is not null")
    once, again = split_repeated(rows, ["record_id"])
    valid = F.pandas_udf(_is_valid, "boolean")
    again = again.where(valid("payload")).withColumn("__age", -F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0)))
    return once.unionByName(keep_one(again, ["record_id"], [F.col("__age")], ["record_id", "payload", "loaded_at"]))


def record_triples(records: DataFrame) -> DataFrame:
    """Path–value–ordinal triples of the last valid delivery of each record, and a row without path for the record. Null keys and
    payloads, and unreadable payloads, give none."""
    return _triples_of(last_deliveries(records))


def _triples_of(deliveries: DataFrame) -> DataFrame:
    return deliveries.select("record_id", "payload").mapInPandas(_read, TRIPLES)


def _ancestor() -> Column:
    """The repeated ancestor a path belongs to."""
    return F.when(F.col("unit_pos") > 0, "unit").when(F.col("scene_pos") > 0, "scene").otherwise("record")


def flat_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The tables `records`, `scenes` and `units`.

    records: record_id, imdb_id, source, n_scenes, n_units. scenes: record_id, scene_pos, scene_number, stage_direction,
    scene_description, n_units. units: record_id, scene_pos, unit_pos, speaker, text. Missing fields are null; a description
    that is a list of strings is joined by line breaks; scene numbers stay strings, as some are "4A". A record without
    scenes is kept in `records`.
    """
    deliveries = last_deliveries(records)
    t = _triples_of(deliveries).withColumn("ancestor", _ancestor())
    units = t.where("ancestor = 'unit'").groupBy("record_id", "scene_pos", "unit_pos").agg(_unit_field(SPEAKER), _unit_field(TEXT))
    scenes = (
        t.where("scene_pos > 0")
        .groupBy("record_id", "scene_pos")
        .agg(*[_scene_field(n) for n in ("scene_number", "stage_direction", "scene_description")], F.max("unit_pos").alias("n_units"))
    )
    tops = t.groupBy("record_id").agg(_root_field("imdb_id"), _root_field("source"), F.max("scene_pos").alias("n_scenes"), F.count(F.when((F.col("unit_pos") > 0) & F.col("value").isNull(), 1)).alias("n_units"))
    # the time of loading goes with the record: a narrow join, no payload
    loaded = deliveries.select("record_id", "loaded_at")
    return {"records": loaded.join(tops, "record_id"), "scenes": scenes, "units": units}


def _unit_field(name: str) -> Column:
    """The field of the unit itself, else the first of that name held deeper in it."""
    depth = F.size(F.split("path", r"[.\[]"))
    return F.min_by("value", F.when((F.substring_index("path", ".", -1) == name) & F.col("value").isNotNull(), F.struct(depth, "seq"))).alias(name)


def _scene_field(name: str) -> Column:
    """The values of a field of the scene in reading order, joined by a line break; null if there is none."""
    own = (F.col("unit_pos") == 0) & (F.regexp_replace(F.substring_index("path", ".", -1), r"\[\]", "") == name)
    values = F.sort_array(F.collect_list(F.when(own, F.struct("seq", "value"))))
    return F.when(F.size(F.filter(values, lambda v: v["value"].isNotNull())) > 0, F.array_join(F.transform(values, lambda v: v["value"]), "\n")).alias(name)


def _root_field(name: str) -> Column:
    return F.max(F.when(F.col("path") == f"$.{name}", F.col("value"))).alias(name)


def unit_positions(records: DataFrame) -> DataFrame:
    """(record_id, scene_pos, unit_pos) of every dialogue unit."""
    return flat_tables(records)["units"].select("record_id", "scene_pos", "unit_pos")
