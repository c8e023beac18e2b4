"""What the members of a group of equal components add to its primary, as rows: no group is gathered.

Members: key, rank (the primary's is the least, ranks differ within a group), and the field in question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(members: DataFrame, field: str, same: Column) -> DataFrame:
    """Array `field` -> (key, item, rank, pos): of items with equal `same` (of `item`) the first, in order of members.

    Items whose `same` is null or '' are dropped.
    """
    items = members.select("key", "rank", F.posexplode(field).alias("pos", "item")).withColumn("same", same).filter("same <> ''")
    return items.groupBy("key", "same").agg(F.min_by(F.struct("item", "rank", "pos"), F.struct("rank", "pos")).alias("f")).select("key", "f.item", "f.rank", "f.pos")


def properties(members: DataFrame, field: str = "props") -> DataFrame:
    """Map `field` -> (key, name, value): the first member's value, and under conflict:name the last that differs."""
    values = members.select("key", "rank", F.explode(field).alias("name", "value")).groupBy("key", "name", "value").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    first = values.groupBy("key", "name").agg(F.min_by("value", "low").alias("kept"))
    other = values.join(first, ["key", "name"]).filter("value <> kept").groupBy("key", "name").agg(F.max_by("value", "high").alias("value"))
    return first.withColumnRenamed("kept", "value").unionByName(other.withColumn("name", F.concat(F.lit("conflict:"), "name")))


def other_layer(members: DataFrame) -> DataFrame:
    """(key, rank, layer) -> key, layer (the first known), also_in_layer (the last that differs), merged (members beyond the primary)."""
    seen = members.groupBy("key", "layer").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("*").alias("n"))
    first = seen.groupBy("key").agg(F.min_by("layer", F.when(F.col("layer").isNotNull(), F.col("low"))).alias("own"), (F.sum("n") - 1).alias("merged"))
    last = seen.join(first, "key").filter("layer <> own").groupBy("key").agg(F.max_by("layer", "high").alias("also_in_layer"))
    return first.join(last, "key", "left").select("key", F.col("own").alias("layer"), "also_in_layer", "merged")
