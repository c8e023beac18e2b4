"""Offline data as folders of JSON files; what a file is about is in its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.functions.identifiers import decoded


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """name (decoded, without .json), folder (the nearest), text of every JSON file below a path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parts = F.split("_metadata.file_path", "/")
    # a file's path comes percent-encoded, so that a name that is encoded itself is encoded twice
    return files.select(decoded(F.regexp_replace(decoded(F.element_at(parts, -1)), r"\.json$", "")).alias("name"), decoded(F.element_at(parts, -2)).alias("folder"), F.col("value").alias("text"))


def entries(text: Column, kind: str) -> Column:
    """The parsed text; null where it isn't an object of JSON."""
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, kind, {"mode": "PERMISSIVE"}))


def cpe_names(spark: SparkSession, root: str, by: str = "purl") -> tuple[DataFrame, DataFrame]:
    """cpe/by-purl or cpe/by-name below a root -> (key, vendor, product), and files that give none, by name.

    The key is the package URL in lower case, or type|name.
    """
    kind = "vendor string, product string"
    files = json_files(spark, f"{root.rstrip('/')}/cpe/by-{by}").withColumn("e", entries(F.col("text"), kind))
    good = F.coalesce((F.col("e.vendor") != "") & (F.col("e.product") != ""), F.lit(False))
    key = F.lower("name") if by == "purl" else F.lower(F.concat_ws("|", "folder", "name"))
    return files.filter(good).select(key.alias("key"), "e.vendor", "e.product"), files.filter(~good).select("name")


def resolved(components: DataFrame, by_purl: DataFrame, by_name: DataFrame) -> DataFrame:
    """(bom_ref, key, type_name) -> vendor and product by package URL, else by type and name."""
    first = by_purl.groupBy("key").agg(F.min(F.struct("vendor", "product")).alias("exact"))
    second = by_name.groupBy(F.col("key").alias("type_name")).agg(F.min(F.struct("vendor", "product")).alias("named"))
    rows = components.join(first, "key", "left").join(second, "type_name", "left").withColumn("hit", F.coalesce("exact", "named"))
    return rows.filter("hit is not null").select("bom_ref", "hit.vendor", "hit.product")


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """fingerprint/<algorithm>/<digest>.json below a root -> alg, h, name, version, purl; a damaged file is an error."""
    files = json_files(spark, f"{root.rstrip('/')}/fingerprint")
    field = lambda *names: F.coalesce(*[F.get_json_object("text", f"$.{n}") for n in names])
    name = field("name", "Name")
    sure = F.when(name.isNull(), F.raise_error(F.concat(F.lit("not a fingerprint: "), "folder", F.lit("/"), "name")).cast("string")).otherwise(name)
    return files.select(F.lower(F.trim("folder")).alias("alg"), F.lower(F.trim("name")).alias("h"), sure.alias("name"), F.coalesce(field("version", "Version"), F.lit("")).alias("version"), F.coalesce(field("purl", "PURL"), F.lit("")).alias("purl"))
