"""Exact linking inside loosely connected blocks.

Loose edges (from signatures) join records into blocks; a true link never leaves its block. Records of a
block are dealt into chunks by hash so that a chunk's payload is bounded, and every pair of chunks is
compared whole by one task; nothing is capped. Tasks emit trees of links, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload units (shingles, characters) and records of a chunk.
CHUNK_UNITS, CHUNK_RECORDS = 2_000_000, 4096


def chunked(members: DataFrame, units: int = CHUNK_UNITS, records: int = CHUNK_RECORDS) -> DataFrame:
    """(node, block, units, ...) -> a row for every pair of chunks that a node belongs to, with its task key.

    Blocks of one chunk, nearly all, give one row a node.
    """
    sizes = members.groupBy("block").agg(F.greatest(F.ceil(F.sum("units") / units), F.ceil(F.count("*") / records)).alias("chunks"))
    dealt = members.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    pairs = dealt.withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1), lambda i: i != F.col("chunk")))))
    # a chunk is compared within itself in each of its pairs
    return pairs.withColumn("task", F.xxhash64("block", F.least("chunk", "other"), F.greatest("chunk", "other"))).drop("chunks", "chunk", "other", "block")


def blocks_of(components: DataFrame) -> DataFrame:
    return components.select("node", F.col("component").alias("block"))


def dealt(rows: DataFrame, spark: SparkSession, key: str, *then: str) -> DataFrame:
    """Rows of one key together and in order."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *then)
