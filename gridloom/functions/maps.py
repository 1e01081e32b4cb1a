"""Maps as nested state: read, set, rename, add and drop by key; keys are data, never code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def put(m: Column, key: str, value: Column) -> Column:
    """The map with the key's value set, whether it was there or not."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def rename(m: Column, old: str, new: str) -> Column:
    """The map with a key renamed; a key that is not there changes nothing, one of the new name is replaced."""
    has = F.map_contains_key(m, F.lit(old))
    moved = F.map_concat(F.map_filter(m, lambda k, _: (k != old) & (k != new)), F.create_map(F.lit(new), F.element_at(m, old)))
    return F.when(has, moved).otherwise(m)


def drop_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())
