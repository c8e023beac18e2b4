"""Mixing sources to target weights: whole copies by rate, one more by a coin that the document's hash tosses.

A source's words are summed (a null text has none), its target is its share of the mix, and its rate is
target over words. A document is emitted floor(rate) times, and once more with the odds of the fraction.

Nulls: a null source is a source of its own, last in order; a null id is an id. Rows of equal id and text toss
the same coin. A source without words has target 0 and is not emitted. An empty table gives no rows. Columns
of any name pass through: results are in one struct column whose name the table doesn't have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is broadcast, by count; more are joined by a shuffle that splits hot keys.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def totals(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, words) as a table in the shared folder; sums are combined before the shuffle, so a hot source is few rows."""
    return materialise(docs.select(docs[source].alias("source"), words(docs[text]).alias("words")).groupBy("source").agg(F.sum("words").alias("words")), docs.sparkSession)


def cycled(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds weights that repeat over the sources in order of code points, null last.

    Places come from ranges of sources and the ranges' counts, so no task sorts them all.
    """
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, spark)
    before = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    place = F.col("before") + F.col("nth")
    return dealt.withColumn("nth", nth).join(before, "range").select("source", "words", F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight"))


def targets(weighted: DataFrame, share: float, most: float) -> DataFrame:
    """(source, words, weight) -> with `target` and `rate`: `share` of all words by weight, `most` times a source's words at most.

    What a stopped source leaves is reshared by weight until none is above. Each round is one aggregation of three
    sums; the level only rises, and a round stops another source or is the last. If all are stopped the mix is smaller.
    """
    spark = weighted.sparkSession
    weighted = materialise(weighted.withColumn("most", most * F.col("words")), spark)
    total = weighted.agg(F.sum("words")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = level * F.col("weight") > F.col("most")
        n, taken, rest = weighted.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped:
            break
        stopped = n
        if not rest:
            level = float("inf")
            break
        level = (share * total - taken) / rest
    target = F.when((F.col("words") == 0) | (F.col("weight") == 0), 0.0).otherwise(F.least(F.col("most"), F.lit(level) * F.col("weight")))
    return weighted.select("source", "words", "weight", target.alias("target"), F.when(F.col("words") > 0, target / F.col("words")).otherwise(0.0).alias("rate"))


def coin(columns: Sequence[Column], seed: str) -> Column:
    """A number from 0 up to 1, the same for the same values in every run."""
    body = F.concat(F.lit(seed), *[F.concat(F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns])
    return F.conv(F.left(F.md5(body), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def drawn(docs: DataFrame, rates: DataFrame, source: str = "source", text: str = "text", key: Sequence[str] = ("doc_id", "text"), seed: str = "mix") -> tuple[DataFrame, str]:
    """Rows with a struct of size, source_size, target and copies, and the struct's name.

    rates: of targets(). No row moves while the sources are few enough to broadcast, by count.
    """
    name = unused(docs, "mix")
    own = rates.select(F.col("source").alias("mix_source"), F.col("words").alias("mix_words"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"))
    # one struct, so that none of the columns can clash with those of the documents
    at = unused(docs, "mix_of")
    own = own.select(F.struct("*").alias(at))
    few = own.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(own) if few else own, docs[source].eqNullSafe(own[f"{at}.mix_source"]), "left")
    rate = F.col(f"{at}.mix_rate")
    whole = F.floor(rate)
    copies = whole + F.when(coin([docs[k] for k in key], seed) < rate - whole, 1).otherwise(0)
    return joined.select(*[docs[c] for c in docs.columns], F.struct(words(docs[text]).alias("size"), F.col(f"{at}.mix_words").alias("source_size"), F.col(f"{at}.mix_target").alias("target"), copies.cast("int").alias("copies")).alias(name)), name


def mixed(docs: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.0, most: float = float("inf"), source: str = "source", text: str = "text", key: Sequence[str] = ("doc_id", "text"), seed: str = "mix") -> DataFrame:
    """The mix: rows as they are, each as often as its rate and its coin say.

    weights: numbers that repeat over the sources in order, or a table (source, weight); sources that it lacks are left out.
    """
    judged, name = drawn(docs, rates(docs, weights, share, most, source, text), source, text, key, seed)
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))
    return judged.filter(F.col(f"{name}.copies") > 0).select(*[judged[c] for c in docs.columns], copies.alias(name)).drop(name)


def rates(docs: DataFrame, weights: Sequence[float] | DataFrame, share: float, most: float, source: str = "source", text: str = "text") -> DataFrame:
    sizes = totals(docs, source, text)
    if isinstance(weights, DataFrame):
        given = weights.select(weights["source"].alias("given"), weights["weight"].cast("double").alias("weight"))
        weighted = sizes.join(given, sizes["source"].eqNullSafe(given["given"]), "left").select("source", "words", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        weighted = cycled(sizes, weights)
    return targets(weighted, share, most)
