"""Property maps of components and documents, and what is read from them.

Null maps, texts and labels count as empty; an empty table gives no rows. Where a key comes twice, the last wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that name a base image, in order, and the one with its digest (fixed values).
BASE_NAMES = ("org.opencontainers.image.base.name", "org.opencontainers.image.base.ref.name")
BASE_DIGEST = "org.opencontainers.image.base.digest"
#: How keys of properties that hold a path start and end (fixed values).
LOCATION = ("syft:location:", ":path")
#: Date and time, seconds with or without a fraction, an offset, Z or nothing.
MOMENT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"

TEXTS = "map<string,string>"


def held(props: Column) -> Column:
    return F.coalesce(props, F.create_map().cast(TEXTS))


def once(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, whatever the number of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_annotations(comments: Column) -> Column:
    """Comments of the form key=value, cut at the first '=', as a map; others are left out."""
    said = F.filter(F.coalesce(comments, F.array().cast("array<string>")), lambda c: F.contains(c, F.lit("=")))
    pairs = F.transform(said, lambda c: F.struct(F.trim(F.substring_index(c, "=", 1)).alias("key"), F.substring(c, F.instr(c, "=") + 1, F.length(c)).alias("value")))
    return once(F.filter(pairs, lambda p: p["key"] != ""), lambda named: F.map_from_entries(last_of(named, "key")))


def last_of(pairs: Column, key: str) -> Column:
    """Of structs with equal keys the last."""
    return once(F.transform(pairs, lambda p: p[key]), lambda keys: F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p[key]) == 0))


def to_annotations(props: Column) -> Column:
    """The opposite of from_annotations(), in order of keys."""
    return F.transform(F.array_sort(F.map_entries(held(props))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))


def cleared(props: Column, prefix: str) -> Column:
    """Without the keys that start with `prefix`."""
    return F.map_filter(held(props), lambda k, _: ~k.startswith(prefix))


def filled(props: Column, new: Column) -> Column:
    """With those entries of `new` whose key isn't there yet."""
    return once(held(props), lambda own: once(F.map_keys(own), lambda known: F.map_concat(own, F.map_filter(held(new), lambda k, _: ~F.array_contains(known, k)))))


def stamped(props: Column, by: str, by_value: str, version: str, version_value: str) -> Column:
    """Who enriched a document, where nobody did yet, and the version, always."""
    own = F.map_filter(held(props), lambda k, _: k != version)
    return F.map_concat(filled(own, F.create_map(F.lit(by), F.lit(by_value))), F.create_map(F.lit(version), F.lit(version_value)))


def locations(evidence: Column, props: Column) -> Column:
    """Paths of the evidence, then those that properties hold, in order of their keys; empty ones are left out."""
    stated = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    own = F.map_filter(held(props), lambda k, v: k.startswith(LOCATION[0]) & k.endswith(LOCATION[1]) & (F.coalesce(v, F.lit("")) != ""))
    return F.concat(stated, F.transform(F.array_sort(F.map_entries(own)), lambda e: e["value"]))


def base_reference(labels: Column) -> Column:
    """The base image that labels name, with the digest unless the name has one; '' without a name."""
    of = lambda k: F.coalesce(F.try_element_at(held(labels), F.lit(k)), F.lit(""))
    name = F.coalesce(*[F.when(of(k) != "", of(k)) for k in BASE_NAMES], F.lit(""))
    return F.when((name != "") & (of(BASE_DIGEST) != "") & ~name.contains("@"), F.concat(name, F.lit("@"), of(BASE_DIGEST))).otherwise(name)


def moment(text: Column) -> Column:
    """A document's time stamp; without an offset it is in UTC; null for other texts."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(MOMENT), zoned.try_cast("timestamp"))


def entries(rows: DataFrame, key: str, props: Column) -> DataFrame:
    """key, name, value: a row for each property."""
    return rows.select(key, F.explode(props).alias("name", "value"))
