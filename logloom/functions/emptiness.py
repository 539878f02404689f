"""One rule for "nothing here": null, '', '-', an empty list and an empty object all become NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.json_walk import pruned_inside


def present(col: Column) -> Column:
    """String value, or NULL when it is '' or '-'."""
    return F.when(~col.isin("", "-"), col)


def present_list(col: Column) -> Column:
    return F.when(F.size(col) > 0, col)


def present_map(col: Column) -> Column:
    return F.when(F.cardinality(col) > 0, col)


def empty_variant(v: Column) -> Column:
    """True for a variant null, '', '-', [] and {}. The text of a value that is none of these is made once, its JSON text only for a value that reads as '[]' or '{}'."""
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    return F.when(text.isin("", "-", "[]", "{}"), text.isin("", "-") | F.to_json(v).isin("[]", "{}")).otherwise(False)


def present_variant(col: Column) -> Column:
    return F.when(~empty_variant(col), col)


def prune_strings(col: Column) -> Column:
    """Array without empty members; NULL when none is left."""
    return present_list(F.filter(col, lambda x: x.isNotNull() & ~x.isin("", "-")))


def prune_map(col: Column) -> Column:
    """String map without empty values; NULL when none is left."""
    return present_map(F.map_filter(col, lambda _, v: v.isNotNull() & ~v.isin("", "-")))


def kept_members(col: Column) -> Column:
    """Variant map without empty values, at any depth inside them."""
    return F.map_filter(F.transform_values(col, lambda _, v: pruned_inside(v)), lambda _, v: v.isNotNull() & ~empty_variant(v))


def prune_variant_map(col: Column) -> Column:
    """As `kept_members`; NULL when none is left."""
    return present_map(kept_members(col))
