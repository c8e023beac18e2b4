"""Answers of several sources of candidates, and where an image comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An offline answer as sure as this makes network sources needless.
SURE = 0.70
MODES = ("hybrid", "offline", "online")
#: What stands before '://' in an image reference and the kind of source it names (fixed values).
SCHEMES = {"registry": "registry", "archive": "archive", "oci": "layout", "docker-daemon": "docker", "podman-daemon": "podman"}


def resolve(candidates: DataFrame, mode: str = "hybrid", sure: float = SURE) -> DataFrame:
    """(key, priority, registered, network, confidence, ...) -> the rows of the sources that are asked, with `place`.

    Sources are asked from the highest priority, then by `registered`. Offline, network sources are left out; in hybrid
    mode those that come after an offline source with an answer of `sure` or more; an unknown mode is hybrid. A null
    priority comes last, a null `network` counts as offline and a null confidence as 0; null keys are one key. A helper
    column `place` is added; a column of that name is replaced. The answers are pre-aggregated by key before they are joined.
    """
    network = F.coalesce(F.col("network"), F.lit(False))
    order = F.struct(-F.coalesce(F.col("priority"), F.lit(-(2**31))).cast("long"), F.coalesce(F.col("registered"), F.lit(0)).cast("long"))
    rows = candidates.withColumn("place", order)
    if mode == "offline":
        return rows.filter(~network)
    if mode == "online":
        return rows
    first = rows.filter(~network & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= sure)).groupBy(F.col("key").alias("sure__key")).agg(F.min("place").alias("sure__place"))
    joined = rows.join(first, F.col("key").eqNullSafe(F.col("sure__key")), "left")
    return joined.filter(~network | F.col("sure__place").isNull() | (F.col("place") < F.col("sure__place"))).drop("sure__key", "sure__place")


def image_source(reference: Column, kind: Column) -> Column:
    """struct(source, body) of an image reference.

    `kind` is what the path of that name is: file, layout, directory, or null where there is none. Without a scheme, files are
    archives and layouts are layouts, a directory of another kind is 'invalid', and the rest is 'detect': daemons, then the
    registry. Unknown schemes are 'unsupported'; a null or empty reference is 'empty'.
    """
    at = F.instr(reference, "://")
    scheme, body = F.substring_index(reference, "://", 1), F.substr(reference, at + 3)
    known = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    parted = (at > 1) & scheme.rlike("^[a-z-]+$")
    explicit = F.coalesce(F.try_element_at(known, scheme), F.lit("unsupported"))
    found = F.when(kind == "file", "archive").when(kind == "layout", "layout").when(kind == "directory", "invalid").otherwise("detect")
    source = F.when(F.coalesce(reference, F.lit("")) == "", "empty").when(parted, explicit).otherwise(found)
    return F.struct(source.alias("source"), F.coalesce(F.when(parted, body).otherwise(reference), F.lit("")).alias("body"))
