"""JSON read strictly: one value, no repeated names, no NaN or Infinity, no number too large for a double."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Bad(ValueError):
    pass


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Bad("repeated name")
    return out


def _constant(name: str):
    raise _Bad("not finite")


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise _Bad("not finite")
    return value


def fault(text: str | None) -> str | None:
    """What is wrong with a JSON text: `blank`, `repeated name`, `not finite`, `no object`, `syntax`; null if nothing."""
    if text is None or not text.strip():
        return "blank"
    try:
        value = json.loads(text, object_pairs_hook=_object, parse_constant=_constant, parse_float=_number)
    except _Bad as e:
        return str(e)
    except (ValueError, RecursionError):
        return "syntax"
    return None if isinstance(value, dict) else "no object"


def json_fault(text: Column) -> Column:
    """fault() of a column."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fault(x) for x in batch], dtype=object)

    return F.pandas_udf(each, "string")(text)
