"""Metadata as maps of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_defaults(have: Column, more: Column) -> Column:
    """have and the entries of more whose keys it lacks and whose values are neither null nor empty. A null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(have, none)
    fresh = F.map_filter(F.coalesce(more, none), lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(own, k))
    return F.map_concat(own, fresh)


def of_columns(columns: dict[str, Column]) -> Column:
    """A map of named values, in the order given."""
    return F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("string"))])
