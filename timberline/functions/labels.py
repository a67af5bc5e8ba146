"""Label sets as sortable keys, and the field map of a pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_TYPE = "array<struct<key:string,value:string>>"


def labels_key(labels: Column) -> Column:
    """A label map as a sorted array of (key, value): unlike a map it can be joined, ordered and deduplicated."""
    return F.coalesce(F.array_sort(F.map_entries(labels)), F.array().cast(KEY_TYPE))


def labels_map(key: Column) -> Column:
    return F.map_from_entries(key)


def get(labels: Column, name: str) -> Column:
    """A label's value; an absent one is empty."""
    return F.coalesce(F.element_at(labels, name), F.lit(""))


def keep(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: x["key"].isin(names)) if names else F.array().cast(KEY_TYPE)


def drop(key: Column, names: list[str]) -> Column:
    return F.filter(key, lambda x: ~x["key"].isin(names)) if names else key


def joined(first: Column, second: Column) -> Column:
    """Both maps; where both have a name, the first one's value."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def first_of_pairs(pairs: Column) -> Column:
    """A list of (key, value) as a map; of pairs with the same key the first stays."""
    fresh = F.filter(F.transform(pairs, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), i.alias("i"))), lambda x: ~F.exists(F.slice(pairs, 1, F.greatest(x["i"], F.lit(0))), lambda y: y["key"] == x["key"]) | (x["i"] == 0))
    return F.map_from_entries(F.transform(fresh, lambda x: F.struct(x["key"], x["value"])))
