"""Fields of JSON whose shape isn't sure, over VARIANT values: what has the wrong type is null, and spoils nothing beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """A VARIANT, or null where the text isn't JSON."""
    return F.try_parse_json(json)


def items(v: Column, path: str = "$") -> Column:
    """The elements of an array, each a VARIANT; none where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def objects(v: Column, path: str = "$") -> Column:
    """Those elements of an array that are objects."""
    return F.filter(items(v, path), lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


def text(v: Column, path: str = "$") -> Column:
    """A string, number or truth value as text; null for an array, an object or nothing."""
    return F.when(F.try_variant_get(v, path, "array<variant>").isNull() & F.try_variant_get(v, path, "map<string,variant>").isNull(), F.try_variant_get(v, path, "string"))


def value(v: Column, path: str, kind: str) -> Column:
    """A value of a type, also where it is written as a string; else null."""
    return F.try_variant_get(v, path, kind)


def texts(v: Column, path: str = "$") -> Column:
    """The elements of an array that have a text, as texts."""
    return F.array_compact(F.transform(items(v, path), lambda x: text(x)))
