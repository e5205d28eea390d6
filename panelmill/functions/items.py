"""Items are ``column=value`` texts; item sets are sorted arrays of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = "nan"


def text_of(name: str) -> Column:
    """A category as text, a missing one as ``nan``."""
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def item_text(name: str) -> Column:
    return F.concat(F.lit(f"{name}="), text_of(name))


def item_column(item: Column) -> Column:
    """The part before the first ``=``, NULL for a text without one."""
    return F.when(item.contains("="), F.substring_index(item, "=", 1))


def item_value(item: Column) -> Column:
    """The part after the first ``=``, NULL for a text without one."""
    return F.when(item.contains("="), F.split(item, "=", 2)[1])


def item_label(item: Column) -> Column:
    """``Soil_Type=Clay`` reads ``Soil Type: Clay``; other texts stay as they are."""
    name = F.replace(item_column(item), F.lit("_"), F.lit(" "))
    return F.when(item.contains("="), F.concat(name, F.lit(": "), item_value(item))).otherwise(item)


def labels_of(items: Column) -> Column:
    return F.array_sort(F.transform(items, item_label))


def joined(items: Column) -> Column:
    """The stored form of an item set: sorted and joined with ``|``."""
    return F.array_join(F.array_sort(items), "|")


def parted(text: Column) -> Column:
    """Back from the stored form; empty parts are no items."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\|")
    return F.array_sort(F.filter(parts, lambda item: item != ""))


def mentions(items: Column, name: str) -> Column:
    """True when some item is of the column ``name``."""
    return F.exists(items, lambda item: item.startswith(f"{name}="))
