"""A table of answers that are asked for again: key, value, fetched_at, in folders by the first two digits of the key's SHA-256.

Of a key's answers the latest stays, of equal times the greatest value. A null value is an answer, too: nothing is known. Null keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.plans.tables import cut

SCHEMA = "key string, value string, fetched_at timestamp, shard string"


def shard(key: Column) -> Column:
    return F.left(F.sha2(key, 256), F.lit(2))


def latest(rows: DataFrame) -> DataFrame:
    newest = F.max(F.struct("fetched_at", "value")).alias("m")
    return rows.filter("key IS NOT NULL").groupBy("key").agg(newest).select("key", "m.value", "m.fetched_at").withColumn("shard", shard(F.col("key")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table, empty where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(folder)


def stored(rows: DataFrame, folder: str, expired: Column | None = None) -> None:
    """Puts answers (key, value, fetched_at) into the table; entries for which `expired` holds go from the folders that are touched.

    Only folders with a new key are written again, each whole and at once, so a run that is repeated, or breaks off, leaves one row a key.
    """
    spark = rows.sparkSession
    new = cut(latest(rows))
    old = read(spark, folder).join(F.broadcast(new.select("shard").distinct()), "shard", "left_semi")  # 256 folders at most
    kept = old.filter(~F.coalesce(expired, F.lit(False))) if expired is not None else old
    both = cut(latest(kept.select("key", "value", "fetched_at").unionByName(new.select("key", "value", "fetched_at"))))
    # folders all of whose entries have expired would stay as they are: each touched folder has a new key
    both.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)


def answered(wanted: DataFrame, layers: list[DataFrame], now: Column, seconds: int | None) -> tuple[DataFrame, DataFrame]:
    """Keys with the answer of the first layer that has one (`layer`, null where none has), and what goes up into the first layer.

    Entries older than `seconds` are none; null keeps them for ever.
    """
    hits = None
    for n, t in enumerate(layers):
        fresh = t if seconds is None else t.filter(F.unix_seconds(now) - F.unix_seconds("fetched_at") <= seconds)
        own = latest(fresh).select("key", F.struct(F.lit(n).alias("layer"), "value", "fetched_at").alias("a"))
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy("key").agg(F.min_by("a", "a.layer").alias("a"))
    told = wanted.select("key").distinct().join(best, "key", "left").select("key", "a.layer", "a.value", "a.fetched_at")
    return told, told.filter("layer > 0").select("key", "value", "fetched_at")
