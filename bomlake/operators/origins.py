"""Where components come from: of an image's base or its own, by the best way that each image allows, all images in one plan.

Null texts and lists count as empty; an empty table gives no rows. Components have image, bom_ref, origin, layer (index or null) and paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlake.functions import paths as P

#: Ways, and the strategy that each is stamped as (fixed values).
CONTENT, PREFIX, PATHS, PARTIAL, NONE = "content", "prefix", "paths", "partial", "unknown"
STRATEGIES = {CONTENT: "content", PREFIX: "path-fallback", PATHS: "path-fallback", PARTIAL: "unavailable", NONE: "unavailable"}
#: Layers from which all but the last may be taken for the base.
LEAST_LAYERS = 2


def ways(images: DataFrame) -> DataFrame:
    """Images (base, reachable, digest_label, n_layers, scanned, compared, prefix) -> with way, strategy and base_layers.

    A base that is named but not reachable, with a digest label: all layers but the last, on trust. A reachable one: by content where
    both images were scanned, else by layers where the base's are the first of the image (prefix, their number, else 0), else by paths.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    way = (
        F.when(F.coalesce("base", F.lit("")) == "", NONE)
        .when(~on("reachable") & on("digest_label") & (F.col("n_layers") >= LEAST_LAYERS), PARTIAL)
        .when(~on("reachable"), NONE)
        .when(on("scanned"), CONTENT)
        .when(~on("compared"), NONE)
        .when(F.coalesce("prefix", F.lit(0)) > 0, PREFIX)
        .otherwise(PATHS)
    )
    names = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    told = images.withColumn("way", way)
    return told.withColumn("strategy", F.element_at(names, F.col("way"))).withColumn("base_layers", F.when(F.col("way") == PARTIAL, F.col("n_layers") - 1).when(F.col("way") == PREFIX, F.col("prefix")).otherwise(0))


def origins(images: DataFrame, components: DataFrame, target: DataFrame, base: DataFrame) -> DataFrame:
    """image, bom_ref, origin, base_path, state, confidence, strategy. Target and base: (image, path, h, ord), whole images' files.

    By content: the first path whose content the base has, else any path that the base has (modified); no paths are unknown.
    By paths: any path that the base has. By layers: unknown without one. Otherwise unknown, unless an origin is there.
    """
    chosen = ways(images).select("image", "way", "strategy", "base_layers")
    rows = components.join(chosen, "image")
    places = rows.filter(F.col("way").isin(CONTENT, PATHS)).select("image", "bom_ref", "way", F.posexplode("paths").alias("pos", "path")).withColumn("path", P.normalised(F.coalesce("path", F.lit("")))).filter("path <> ''")
    final = target.groupBy("image", "path").agg(F.max_by("h", "ord").alias("h"))
    by_hash = base.groupBy("image", "h").agg(F.min_by("path", "ord").alias("base_path"))
    known = base.select("image", "path", F.lit(True).alias("known")).distinct()
    found = places.join(final, ["image", "path"], "left").join(by_hash, ["image", "h"], "left").join(known, ["image", "path"], "left")
    told = found.groupBy("image", "bom_ref").agg(F.min_by("base_path", F.when(F.col("base_path").isNotNull() & (F.col("way") == CONTENT), F.col("pos"))).alias("base_path"), F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
    rows = rows.join(told, ["image", "bom_ref"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    some = F.size(F.filter(F.coalesce("paths", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")) > 0
    content, hit = F.col("way") == CONTENT, F.col("base_path").isNotNull()
    origin = (
        F.when(content & ~some, "unknown")
        .when(content | (F.col("way") == PATHS), F.when(F.col("known") | (content & hit), "base").otherwise("app"))
        .when(F.col("way").isin(PREFIX, PARTIAL), F.when(F.col("layer").isNull(), "unknown").when(F.col("layer") < F.col("base_layers"), "base").otherwise("app"))
        .when(F.coalesce("origin", F.lit("")) != "", F.col("origin"))
        .otherwise("unknown")
    )
    return rows.select(
        "image", "bom_ref", origin.alias("origin"), F.when(content & hit, F.col("base_path")).otherwise("").alias("base_path"), F.when(content & ~hit & F.col("known"), "modified").otherwise("").alias("state"),
        F.when(F.col("way") == PARTIAL, "low").otherwise("").alias("confidence"), "strategy",
    )
