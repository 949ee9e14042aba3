"""Columnar shredding of nested JSON records and reconstruction of flat child tables.

Every record becomes one column per leaf path: its values with a repetition level (at which array the value repeats; 0 starts
a record) and a definition level (how much of the path is there). A path is written with `[]` behind every array. The level
sequences of the leaf columns alone give back every array element that is an object, its positions and its parent. Only where
no object of an array has a value anywhere below is the array a leaf itself: its path then ends in `{}`.

Null, broken or non-object JSON has no columns. Null fields and missing fields are the same; null elements keep their
position. Of repeated field names the last one counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

_MISSING = object()
_SURROGATE = re.compile("[\ud800-\udfff]")
_FIELDS = ["path", "max_def", "reps", "defs", "vals"]
COLUMNS = "array<struct<path:string, max_def:int, reps:array<int>, defs:array<int>, vals:array<string>>>"


def _text(value) -> str:
    s = value if isinstance(value, str) else str(value) if type(value) is int else json.dumps(value)
    if s.isascii():
        return s
    try:
        s.encode()
    except UnicodeEncodeError:  # half of a surrogate pair from an escape
        s = _SURROGATE.sub("\ufffd", s)
    return s


def _reject(name: str):
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_reject)


def _unpack(value, name: str, single: frozenset, packed: frozenset):
    """A field's value: JSON text in a string read as what it holds, one object in place of an array as an array."""
    if name in packed and isinstance(value, str):
        try:
            inner = _JSON.decode(value)
        except (ValueError, RecursionError):
            inner = None
        if isinstance(inner, dict | list):
            value = inner
    return [value] if name in single and isinstance(value, dict) else value


def shred_record(text: str | None, single: frozenset, packed: frozenset) -> list[tuple]:
    """The columns of one record: (path, max_def, reps, defs, vals)."""
    if not text:
        return []
    try:
        record = _JSON.decode(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(record, dict):
        return []
    out: list[tuple] = []

    def leaf(path: str, depth: int, entries: list[tuple], at: int) -> None:
        plain = [None if v is _MISSING or v is None or isinstance(v, dict | list) else _text(v) for _, _, v in entries]
        out.insert(at, (path, depth, [e[0] for e in entries], [e[1] for e in entries], plain))

    def walk(path: str, depth: int, lists: int, entries: list[tuple]) -> None:
        # entries: (repetition, definition, value) of every place where this path could stand
        element, before = path.endswith("[]"), len(out)
        names: dict[str, None] = {}
        scalar = array = objects = False
        for _, _, v in entries:
            if isinstance(v, dict):
                objects = True
                names.update(dict.fromkeys(v))
            elif isinstance(v, list):
                array = True
            elif v is not _MISSING and v is not None:
                scalar = True
        if array:
            below = []
            for r, d, v in entries:
                if isinstance(v, list) and v:
                    below.append((r, d + 1, v[0]))
                    below.extend((lists + 1, d + 1, x) for x in v[1:])
                else:
                    below.append((r, d, _MISSING))
            walk(path + "[]", depth + 1, lists + 1, below)
        inner = len(out)
        if len(entries) == 1 and objects:
            r, d, v = entries[0]
            for name, x in v.items():
                x = None if x is None else _unpack(x, name, single, packed)
                full = f"{path}.{_text(name)}" if path else _text(name)
                if isinstance(x, dict | list) or (x is not None and full.endswith("[]")):
                    walk(full, depth + 1 + element, lists, [(r, d + element + 1, x)])
                elif x is not None:
                    out.append((full, depth + 1 + element, [r], [d + element + 1], [_text(x)]))
            names = {}
        for name in names:
            special, nested, some, below = name in single or name in packed, False, False, []
            for r, d, v in entries:
                x = v.get(name) if isinstance(v, dict) else None
                if special and x is not None:
                    x = _unpack(x, name, single, packed)
                here = d + (element and isinstance(v, dict))
                if x is None:
                    below.append((r, here, _MISSING))
                else:
                    below.append((r, here + 1, x))
                    some = True
                    nested = nested or isinstance(x, dict | list)
            full = f"{path}.{_text(name)}" if path else _text(name)
            if nested or full.endswith("[]"):
                walk(full, depth + 1 + element, lists, below)
            elif some:  # plain values only
                leaf(full, depth + 1 + element, below, len(out))
        if scalar:
            leaf(path, depth, entries, before)
            inner += 1
        if element and objects and len(out) == inner:
            out.append((path + "{}", depth + 1, [e[0] for e in entries], [d + isinstance(v, dict) for _, d, v in entries], None))

    walk("", 0, 0, [(0, 0, record)])
    return out


@lru_cache(maxsize=4096)
def levels(path: str) -> list[int]:
    """For each array of a path the definition level from which its element is an object."""
    level, out = 0, []
    for piece in path.removesuffix("{}").split("."):
        level += 1 + bool(out and last)
        if out and last:
            out[-1] = level - 1
        last = 0
        while piece.endswith("[]"):
            piece = piece[:-2]
            last += 1
        for _ in range(last):
            level += 1
            out.append(10**9)  # an element that is an array or a plain value
    if path.endswith("{}"):
        out[-1] = level + 1
    return out


def slots(reps: Sequence[int], lists: int) -> Iterator[list[int]]:
    """The positions in every array on the way, of every slot of a column; the list is changed in place."""
    at = [0] * lists
    for r in reps:
        if r:
            at[r - 1] += 1
            at[r:] = [0] * (lists - r)
        else:
            at[:] = [0] * lists
        yield at


def record_elements(columns: Sequence) -> list[tuple[str, str, str, str]]:
    """(path, idx, parent path, parent idx) of every object in an array, from the level sequences of a record's columns."""
    found: dict[tuple[str, str], tuple[str, str]] = {}
    told: set[tuple] = set()
    for c in columns:
        path = c["path"]
        lists = path.count("[]")
        if not lists:
            continue
        need, plain, up = _arrays(path)
        top = max(need)
        same = (plain[-1], tuple(c["reps"]), tuple([min(d, top) for d in c["defs"]]))
        if same in told:  # a leaf beside one that has told the same elements
            continue
        told.add(same)
        for d, at in zip(c["defs"], slots(c["reps"], lists), strict=True):
            for k in range(lists):
                if d >= need[k]:
                    idx = "/".join(map(str, at[: k + 1]))
                    if (plain[k], idx) not in found:
                        found[plain[k], idx] = (up[k], "/".join(map(str, at[:k])))
    return [(*key, *parent) for key, parent in found.items()]


@lru_cache(maxsize=4096)
def _arrays(path: str) -> tuple[list[int], list[str], list[str]]:
    """levels, and for each array of a path its name and that of the array around it."""
    ends = [m.end() for m in re.finditer(r"\[\]", path)]
    plain = [path[:e].replace("[]", "") for e in ends]
    return levels(path), plain, ["", *plain[:-1]]


def record_table(columns: Sequence, path: str, fields: Sequence[str]) -> list[tuple[str, str, list]]:
    """(idx, parent idx, values) of every element of the array path, given with its `[]`. A field that is a plain array gives JSON text."""
    plain, lists = path.replace("[]", ""), path.count("[]")
    values: dict[str, list] = {idx: [None] * len(fields) for p, idx, _, _ in record_elements([c for c in columns if c["path"].startswith(path)]) if p == plain}
    by = {c["path"]: c for c in columns}
    for k, field in enumerate(fields):
        c = by.get(f"{path}.{field}")
        if c is not None:
            for v, at in zip(c["vals"], slots(c["reps"], lists), strict=True):
                if v is not None:
                    values["/".join(map(str, at))][k] = v
        c = by.get(f"{path}.{field}[]")
        if c is not None and c["vals"] is not None:
            many: dict[str, list] = {}
            for v, at in zip(c["vals"], slots(c["reps"], lists + 1), strict=True):
                if v is not None:
                    many.setdefault("/".join(map(str, at[:lists])), []).append(v)
            for idx, vs in many.items():
                values[idx][k] = json.dumps(vs, ensure_ascii=False)
    return [(idx, idx.rpartition("/")[0], v) for idx, v in values.items()]


def record_values(columns: Sequence) -> list[tuple]:
    """Every plain value in an element: path, idx, parent path, parent idx, field, positions in plain arrays below, value."""
    out = []
    for c in columns:
        m = re.match(r"^(.*\[\])\.(.+)$", c["path"])
        if m is None or c["vals"] is None:
            continue
        own, lists = m[1], c["path"].count("[]")
        depth = own.count("[]")
        head = own.removesuffix("[]")
        up = head[: head.rfind("[]") + 2].replace("[]", "") if "[]" in head else ""
        for v, at in zip(c["vals"], slots(c["reps"], lists), strict=True):
            if v is not None:
                places = [str(x) for x in at]
                out.append((own.replace("[]", ""), "/".join(places[:depth]), up, "/".join(places[: depth - 1]), m[2].replace("[]", ""), "/".join(places[depth:]), v))
    return out


def shred(df: DataFrame, ids: list[str], column: str, single: Sequence[str] = (), packed: Sequence[str] = ()) -> DataFrame:
    """ids and the columns of each record: an array of path, max_def, reps, defs, vals. Records without columns are left out.

    single: names of fields where an object stands for an array of one. packed: names of fields that may hold JSON text.
    """
    one, text = frozenset(single), frozenset(packed)

    @F.pandas_udf(COLUMNS)
    def columns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(_FIELDS, c, strict=True)) for c in shred_record(x, one, text)] for x in batch], dtype=object)

    return spread(df.where(F.col(column).isNotNull()).select(*ids, column)).select(*ids, columns(F.col(column)).alias("columns"))


def _each(kind: str, f, *args) -> Column:
    """The rows that f makes of a record's columns."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([f(x, *args) for x in batch], dtype=object)

    return F.pandas_udf(each, f"array<struct<{kind}>>")(F.col("columns"))


@dataclass(frozen=True)
class Records:
    """Records that are shredded and rebuilt in one batch, where a row's columns are needed for nothing else."""

    df: DataFrame
    column: str
    single: Sequence[str] = ()
    packed: Sequence[str] = ()

    def rows(self, ids: list[str], kind: str, f, *args) -> DataFrame:
        one, text = frozenset(self.single), frozenset(self.packed)

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([f([dict(zip(_FIELDS, c, strict=True)) for c in shred_record(x, one, text)], *args) for x in batch], dtype=object)

        rebuilt = F.pandas_udf(each, f"array<struct<{kind}>>")(F.col(self.column))
        return spread(self.df.where(F.col(self.column).isNotNull()).select(*ids, self.column)).select(*ids, F.inline(rebuilt))


def _rows(columns: DataFrame | Records, ids: list[str], kind: str, f, *args) -> DataFrame:
    """ids and the rows that f makes of the columns of each record."""
    return columns.rows(ids, kind, f, *args) if isinstance(columns, Records) else columns.select(*ids, F.inline(_each(kind, f, *args)))


_LINK = "path:string, idx:string, parent_path:string, parent_idx:string"


def elements(columns: DataFrame | Records, ids: list[str]) -> DataFrame:
    """One row per object in an array: ids, path, idx, parent_path, parent_idx.

    path has the field names joined by `.`, idx the positions in every array on the way joined by `/`. The parent is the
    array element around it; objects in top-level arrays have the record itself as parent: parent_path and parent_idx ''.
    """
    return _rows(columns, ids, _LINK, record_elements)


def child_values(columns: DataFrame | Records, ids: list[str]) -> DataFrame:
    """Every child of every kind with all its values, one a row: ids, path, idx, parent_path, parent_idx, field, pos, value.

    Each array element has one row without field, and one more for each plain value below it that lies in no element of a
    deeper array. field is the path below the element. Values in a plain array have their positions in it as pos, others ''.
    """
    def rows(c: Sequence) -> list[tuple]:
        return [(*x, None, None, None) for x in record_elements(c)] + record_values(c)

    return _rows(columns, ids, _LINK + ", field:string, pos:string, value:string", rows)


def child_table(columns: DataFrame | Records, ids: list[str], path: str, fields: Sequence[str]) -> DataFrame:
    """The flat table of one repeated ancestor, given with its `[]`: ids, idx, parent_idx and the fields as strings.

    Fields are paths below the ancestor; absent ones are null, and plain arrays are JSON text.
    """
    rows = _rows(columns, ids, "idx:string, parent_idx:string, vals:array<string>", record_table, path, list(fields))
    return rows.select(*ids, "idx", "parent_idx", *[F.get("vals", F.lit(i)).alias(f.replace(".", "_")) for i, f in enumerate(fields)])
