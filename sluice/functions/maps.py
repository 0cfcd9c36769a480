"""Map columns: overlays that never raise on a duplicate key, and comparable text of a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlay(under: Column, over: Column) -> Column:
    """Entries of both maps; `over` wins. Null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    under, over = F.coalesce(under, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def as_text(m: Column) -> Column:
    """`k=v` entries sorted and joined by `;`."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")


def without(m: Column, name: Column) -> Column:
    """Entries whose key is not `name` in any case."""
    return F.map_filter(m, lambda k, v: F.lower(k) != F.lower(name))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
