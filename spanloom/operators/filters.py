"""The filter language: a JSON list of typed predicates over whitelisted columns."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, MAX_FILTERS = 64 * 1024, 50
_ORDER = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


class FilterError(ValueError):
    pass


def _value(value: object, kind: str) -> Column:
    if kind == "datetime":
        return F.lit(datetime.fromisoformat(str(value).replace("Z", "+00:00")).replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit(value)


def predicate(item: dict, columns: dict[str, str]) -> Column:
    """One filter as a Column; ``columns`` maps the names that may be used to columns."""
    kind, name, op, value = (item.get(k) for k in ("type", "column", "operator", "value"))
    if name not in columns:
        raise FilterError(f"column not allowed: {name}")
    c = F.col(columns[name])
    if kind in ("datetime", "number") and op in _ORDER:
        return getattr(c, _ORDER[op])(_value(value, kind))
    if kind in ("number", "string", "boolean") and op == "=":
        return c == F.lit(value)
    if kind == "boolean" and op == "<>":
        return c != F.lit(value)
    if kind == "string" and op in ("contains", "starts_with", "ends_with"):
        return getattr(c, {"contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}[op])(value)
    if kind == "string_options" and op in ("any of", "none of"):
        if not value:
            return F.lit(True)
        hit = F.arrays_overlap(c, F.array(*map(F.lit, value))) if name == "tags" else c.isin(list(value))
        return hit if op == "any of" else ~hit
    if kind == "null" and op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    raise FilterError(f"no such filter: {kind} {op}")


def parse_filters(text: str | None, columns: dict[str, str]) -> Column:
    """All filters of a JSON text, combined by and."""
    if not text:
        return F.lit(True)
    if len(text.encode()) > MAX_BYTES:
        raise FilterError("filters too long")
    items = json.loads(text)
    if not isinstance(items, list) or len(items) > MAX_FILTERS:
        raise FilterError("filters must be a list of at most 50")
    return all_of(predicate(x, columns) for x in items)


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def order_by(text: str | None, allowed: dict[str, str], default: str) -> tuple[str, bool]:
    """(column, descending) of ``column[:asc|:desc]``."""
    name, _, way = (text or default).partition(":")
    if name not in allowed or way not in ("", "asc", "desc"):
        raise FilterError(f"cannot order by {text}")
    return allowed[name], way != "asc"
