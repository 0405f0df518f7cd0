"""Columnar shredding of nested JSON records and reconstruction of flat tables.

A record is cut into one column per leaf path. Every entry of such a column has a repetition level (which
repeated ancestor starts anew with it) and a definition level (how many of the optional steps of its path are
there). A flat table for any repeated ancestor is rebuilt from these level sequences alone, by cumulative
counts, without going back to the record.

Each repeated ancestor has besides its fields a leaf ``#``: the position in the delivered array. Elements that
are no objects yield no entry but count in the positions.

Defined results
---------------
* null record: status ``null``; every level sequence has one entry of definition level 0.
* text that is no valid JSON (also ``NaN`` and an empty text): status ``invalid``, no level sequences; ``reconstruct``
  gives no rows, the record's own row stays in the table of records. Nesting of any depth is read.
* half of a surrogate pair, which JSON can escape and a text can't hold, is read as U+FFFD.
* a string that holds JSON stands for what it holds, at any level; a single object stands for an array of one.
* missing, null, empty or unusable children: one entry, null, at the level of the last ancestor that is there.
* a leaf whose value is an object or array is null; other values are kept as text (``true``, ``12``, ``1.5``).
* repeated rows are shredded each for itself; columns of the input beside the key and record columns are not touched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """A repeated ancestor: its name, the paths of its scalar leaves and the repeated groups in it."""

    name: str
    leaves: tuple[str, ...] = ()
    groups: tuple["Group", ...] = field(default=())


def chain(root: Group, path: str) -> list[Group]:
    """The groups from ``root`` to the one at ``path`` (names joined by dots)."""
    found, here = [root], root
    for name in path.split(".")[1:]:
        here = next(g for g in here.groups if g.name == name)
        found.append(here)
    return found


def column_name(path: str, leaf: str) -> str:
    return f"{path}.{leaf}".replace(".", "/")


def columns_of(root: Group, path: str = "") -> list[str]:
    """Names of all leaf columns below ``root``, each group's ``#`` first."""
    path = f"{path}.{root.name}" if path else root.name
    out = [column_name(path, x) for x in ("#", *root.leaves)]
    for g in root.groups:
        out += columns_of(g, path)
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def _integer(digits: str) -> int | str:
    return int(digits) if len(digits) < 4000 else digits


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer)
_BLANKS = re.compile(r"[ \t\n\r]*")
#: Words and numbers: all up to the next sign that can't be in one.
_SCALAR = re.compile(r"[^\s,:\[\]{}\"]+")
_HALF = re.compile("[\ud800-\udfff]")


def _decode(text: str) -> object:
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _decode_deep(text)


def _decode_deep(text: str) -> object:
    """As the decoder, for nesting beyond its depth: arrays and objects that are still open wait in a list."""

    def skip(at: int) -> int:
        return _BLANKS.match(text, at).end()

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no name at {at}")
        word, at = json.decoder.scanstring(text, at + 1)
        if text[(at := skip(at)) : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return word, skip(at + 1)

    waiting: list[tuple[list | dict, str | None]] = []
    at = skip(0)
    while True:
        sign = text[at : at + 1]
        if sign in ("[", "{") and sign:
            value: object = [] if sign == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != ("]" if sign == "[" else "}"):
                key = None
                if sign == "{":
                    key, at = name(at)
                waiting.append((value, key))
                continue
            at += 1
        elif sign == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        elif m := _SCALAR.match(text, at):
            value, at = _DECODER.decode(m.group()), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while waiting:  # the value is whole: to what holds it
            holder, key = waiting[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            at = skip(at)
            sign = text[at : at + 1]
            if sign == ",":
                at = skip(at + 1)
                if key is not None:
                    key, at = name(at)
                    waiting[-1] = (holder, key)
                break
            if sign != ("]" if key is None else "}"):
                raise ValueError(f"no end at {at}")
            waiting.pop()
            value, at = holder, at + 1
        else:
            if skip(at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def _strings(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([x if x is None else _HALF.sub("\ufffd", x) for x in values], pa.string())


def _stands_for(value: object) -> object:
    """What a value holds: a string of JSON is read, as often as it holds one."""
    while isinstance(value, str):
        try:
            value = _decode(value)
        except ValueError:
            return value
    return value


def _children(value: object) -> list[tuple[int, dict]]:
    value = _stands_for(value)
    if isinstance(value, dict):
        return [(0, value)]
    if not isinstance(value, list):
        return []
    found = []
    for k, x in enumerate(value):
        if isinstance(x := _stands_for(x), dict):
            found.append((k, x))
    return found


def _leaf(value: object, path: str) -> str | None:
    for step in path.split("."):
        if not isinstance(value, dict):
            value = _stands_for(value)
        value = value.get(step) if isinstance(value, dict) else None
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _compile(root: Group, keep: set[str]) -> list:
    """Plan nodes [leaf columns, child plans, field name, depth]; groups without a wanted column are cut."""

    def node(g: Group, path: str, depth: int) -> list | None:
        own = [(column_name(path, x), x) for x in ("#", *g.leaves) if column_name(path, x) in keep]
        below = [n for c in g.groups if (n := node(c, f"{path}.{c.name}", depth + 1))]
        return [own, below, g.name, depth] if own or below else None

    return node(root, root.name, 1)


def shred_value(value: object, plan: list | None, out: dict[str, tuple[list, list, list]]) -> None:
    """Append the entries of one parsed record to ``out``: column -> (repetition, definition, value)."""

    def empty(n: list, rep: int, level: int) -> None:
        for name, _ in n[0]:
            r, d, v = out[name]
            r.append(rep), d.append(level), v.append(None)
        for c in n[1]:
            empty(c, rep, level)

    def fill(n: list, holder: object, rep: int) -> None:
        depth, found = n[3], _children(holder)
        if not found:
            empty(n, rep, depth - 1)
        for pos, obj in found:
            for name, leaf in n[0]:
                r, d, v = out[name]
                x = str(pos) if leaf == "#" else _leaf(obj, leaf)
                # the leaf itself is one optional step more than its group
                r.append(rep), d.append(depth + (x is not None)), v.append(x)
            for c in n[1]:
                fill(c, obj.get(c[2]), rep)
            rep = depth

    if plan:
        fill(plan, value, 0)


def shred(df: DataFrame, record: str, root: Group, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each row of ``df``: its ``keys``, ``status`` and per wanted leaf column a struct of level arrays.

    ``columns`` names the leaf columns to shred (all of them if None); others cost nothing.
    """
    wanted = columns if columns is not None else columns_of(root)
    spark_cols = [f"`{c}` struct<r:array<tinyint>,d:array<tinyint>,v:array<string>>" for c in wanted]
    source = df.select(*[F.col(k) for k in keys], F.col(record).alias("__record"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["status string", *spark_cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _compile(root, set(wanted))
        arrow = pa.struct([("r", pa.list_(pa.int8())), ("d", pa.list_(pa.int8())), ("v", pa.list_(pa.string()))])
        for batch in batches:
            status: list[str] = []
            out: dict[str, tuple[list, list, list]] = {c: ([], [], []) for c in wanted}
            starts: dict[str, list[int]] = {c: [0] for c in wanted}
            for text in batch.column("__record").to_pylist():
                if text is None:
                    status.append("null")
                    shred_value(None, plan, out)
                else:
                    try:
                        value = _decode(text)
                    except ValueError:
                        status.append("invalid")
                    else:
                        status.append("ok")
                        shred_value(value, plan, out)
                for c in wanted:
                    starts[c].append(len(out[c][0]))
            arrays = [batch.column(k) for k in keys] + [pa.array(status, pa.string())]
            for c in wanted:
                at = pa.array(starts[c], pa.int32())
                r, d, v = out[c]
                parts = [pa.ListArray.from_arrays(at, x) for x in (pa.array(r, pa.int8()), pa.array(d, pa.int8()), _strings(v))]
                arrays.append(pa.StructArray.from_arrays(parts, fields=list(arrow)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "status", *wanted])

    return source.mapInArrow(run, schema)


def _levels(struct: pa.StructArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Repetition, definition and value entries of a leaf column, and for each entry its row in the batch."""
    r, d, v = (struct.field(k) for k in range(3))
    rows = np.repeat(np.arange(len(r)), np.diff(r.offsets.to_numpy()))
    return r.flatten().to_numpy(), d.flatten().to_numpy(), v.flatten(), rows


def reconstruct(shredded: DataFrame, root: Group, path: str, keys: list[str], leaves: list[str] = (), every: bool = False) -> DataFrame:
    """The flat table of the repeated ancestor at ``path``: keys, ``<group>_pos`` of it and its ancestors, its leaves.

    With ``every``, ancestors without children keep one row with -1 at the missing levels; else only instances come.
    """
    groups = chain(root, path)
    names = path.split(".")
    columns = [column_name(".".join(names[: k + 1]), "#") for k in range(len(names))]
    wanted = [column_name(path, x) for x in leaves]
    pos = [f"{n.rstrip('s') if n.endswith('s') else n}_pos" for n in names]
    need = list(dict.fromkeys([*columns, *wanted]))
    source = shredded.select(*keys, *[F.col(f"`{c}`") for c in need]).where(F.col("status") != "invalid")
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    flat = [x.replace(".", "_") for x in leaves]
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{p} bigint" for p in pos] + [f"`{x}` string" for x in flat])
    deep = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, level, _, rows = _levels(batch.column(columns[-1]))
            at = np.arange(len(rep))  # entry of the own column; then, step by step, of the ancestors' columns
            found: list[np.ndarray] = [None] * deep
            above = None
            for k in range(deep - 1, -1, -1):
                r, d, v, _ = _levels(batch.column(columns[k]))
                if above is not None:  # an ancestor has one entry for each of ours that doesn't repeat below it
                    at = (np.cumsum(above <= k + 1) - 1)[at]
                have = d >= k + 1
                value = np.where(have, v.cast(pa.int64()).fill_null(-1).to_numpy(), -1)
                found[k] = value[at]
                above = r
            keep = np.ones(len(rep), bool) if every else level >= deep
            take = pa.array(rows[keep])
            arrays = [batch.column(k).take(take) for k in keys] + [pa.array(x[keep], pa.int64()) for x in found]
            for c in wanted:
                arrays.append(_levels(batch.column(c))[2].filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *pos, *flat])

    return source.mapInArrow(run, schema)


#: The chronology records: events, their sources, the sources' references.
TIMELINE = Group(
    "events",
    ("event_id", "time.text", "time.year_start", "time.year_end", "time.section", "event", "source_location.document_id", "source_location.line"),
    (
        Group(
            "sources",
            ("text", "story_name", "activity_name"),
            (Group("references", ("document_id", "line_start", "line_end")),),
        ),
    ),
)
LEVELS = ("events", "events.sources", "events.sources.references")


def timeline_tables(df: DataFrame) -> dict[str, DataFrame]:
    """``activity_timelines`` as related tables ``activities``, ``events``, ``sources`` and ``references``.

    Every child has the ``row_id`` and ``activity_id`` of its row and the positions of its ancestors. ``activities``
    has one row for each input row, whatever its ``events`` hold, and says in ``status`` whether they could be read; a
    column of that name in the input gives way.
    """
    keys = ["row_id", "activity_id"]
    shredded = shred(df, "events", TIMELINE, keys)
    out = {"activities": shred(df, "events", TIMELINE, [c for c in df.columns if c not in ("events", "status")], [])}
    number = {"time_year_start", "time_year_end", "source_location_line", "line_start", "line_end"}
    for path in LEVELS:
        group = chain(TIMELINE, path)[-1]
        flat = reconstruct(shredded, TIMELINE, path, keys, list(group.leaves))
        out[path.split(".")[-1]] = flat.withColumns({c: F.col(c).try_cast("int") for c in flat.columns if c in number})
    return out


def timeline_leaves(df: DataFrame) -> DataFrame:
    """(row_id, event_pos, source_pos, reference_pos) of every leaf of the tree; -1 where a level has no child."""
    columns = [column_name(p, "#") for p in LEVELS]
    shredded = shred(df, "events", TIMELINE, ["row_id"], columns)
    return reconstruct(shredded, TIMELINE, LEVELS[-1], ["row_id"], every=True)
