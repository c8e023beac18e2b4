"""Paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    """Slashes forward, no leading './' or '/', '.' and '..' resolved; '' for the root."""
    parts = F.filter(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)?/?", ""), "/"), lambda p: ~p.isin("", "."))
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    # a stack in an array; the guard keeps element_at() from an empty one
    safe = lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(up(a, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), safe), "/")


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last element."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))
