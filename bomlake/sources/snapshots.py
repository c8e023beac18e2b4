"""Snapshots of lifecycles: products with their cycles, from and to one JSON document.

A cycle's end of life and end of support are dates or booleans, its long-term support a boolean or a text. Products whose name starts with an
underscore are notes, names are in lower case. A document that is no such object raises an error when it is read; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.operators import lifecycles
from bomlake.plans.tables import renamed
from bomlake.sources import writers

CYCLE = "array<struct<cycle:string,releaseDate:string,support:variant,eol:variant,latest:string,lts:variant>>"


def cycles(documents: DataFrame, text: str = "text") -> DataFrame:
    """product, pos, cyc, rel, support, support_flag, eol, eol_flag, latest, lts of every cycle."""
    sound = lambda value, what: F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"no snapshot of lifecycles: {what}")))
    pairs = documents.select(F.explode(sound(F.from_json(text, "map<string,string>"), "the document")).alias("product", "json")).filter("NOT startswith(product, '_')")
    rows = pairs.select(F.lower("product").alias("product"), F.posexplode(sound(F.from_json("json", CYCLE), "a product's cycles")).alias("pos", "c"))
    raw = lambda c: F.when(~F.is_variant_null(F.col(f"c.{c}")), F.to_json(F.col(f"c.{c}")))
    told = rows.withColumns({"s": lifecycles.date_or_flag(raw("support")), "e": lifecycles.date_or_flag(raw("eol"))})
    flag = lambda c: F.coalesce(f"{c}.flag", F.lit(""))
    return told.select(
        "product", "pos", F.coalesce("c.cycle", F.lit("")).alias("cyc"), lifecycles.iso_date(F.col("c.releaseDate")).alias("rel"), F.col("s.date").alias("support"), flag("s").alias("support_flag"),
        F.col("e.date").alias("eol"), flag("e").alias("eol_flag"), F.coalesce("c.latest", F.lit("")).alias("latest"), F.coalesce(lifecycles.long_term(raw("lts")), F.lit(False)).alias("lts"),
    )


def cycle_json(c: DataFrame) -> Column:
    """A cycle as it is written: dates as texts, else booleans, else nothing; what isn't known is left out."""
    either = lambda date, flag: F.when(c[date].isNotNull(), F.concat(F.lit('"'), c[date].cast("string"), F.lit('"'))).when(c[flag] != "", c[flag])
    pair = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    parts = [pair("cycle", writers.quoted(c["cyc"])), pair("eol", either("eol", "eol_flag")), pair("latest", writers.quoted(c["latest"])), pair("lts", c["lts"].cast("string")), pair("releaseDate", F.when(c["rel"].isNotNull(), F.concat(F.lit('"'), c["rel"].cast("string"), F.lit('"')))), pair("support", either("support", "support_flag"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fragments(found: DataFrame) -> DataFrame:
    """Cycles as ordered fragments (product, key, text) of one JSON object, products in order of name, their cycles in order."""
    rows = found.select("product", "pos", cycle_json(found).alias("json"))
    last = rows.groupBy("product").agg(F.max("pos").alias("last"), F.min("pos").alias("first"))
    least = rows.agg(F.min("product").alias("least"))  # one row
    ends = rows.join(last, "product").join(F.broadcast(least))
    mark = F.when(F.col("pos") == F.col("first"), F.concat(F.when(F.col("product") == F.col("least"), "{").otherwise(","), writers.quoted(F.col("product")), F.lit(":["))).otherwise(",")
    body = ends.select("product", F.format_string("%010d", "pos").alias("key"), F.concat(mark, "json", F.when(F.col("pos") == F.col("last"), "]").otherwise("")).alias("text"))
    return body.unionByName(least.select(F.lit("\U0010ffff").alias("product"), F.lit("~").alias("key"), F.when(F.col("least").isNull(), "{}").otherwise("}").alias("text")))


def document(found: DataFrame) -> DataFrame:
    """(text): the snapshot as one text. Products are those of a mapping, some dozens, so it fits a row."""
    f = fragments(found).select(F.lit("snapshot").alias("sbom_id"), F.lit(0).alias("part"), F.concat_ws("\u0001", "product", "key").alias("key"), "text")
    return writers.assembled(f).select("text")


def published(found: DataFrame, folder: str) -> None:
    """Writes the snapshot to a folder beside and puts it in place of the old one, which readers see until then."""
    renamed(document(found).coalesce(1), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return cycles(spark.read.text(folder, wholetext=True).select(F.rtrim("value").alias("text")))


def matched(wanted: DataFrame, *tables: DataFrame) -> DataFrame:
    """(bom_ref, product, version) -> with source (number of the table) and its first cycle that fits, by the first table that has one.

    A cycle fits if it is the version, or the version without a leading v. Components that no table has are left out.
    """
    rows = wanted.filter("version <> ''")
    both = rows.select("bom_ref", "product", "version", F.explode(F.array_distinct(F.array("version", F.regexp_replace("version", "^v", "")))).alias("cyc"))
    hits = None
    for n, t in enumerate(tables):
        own = both.join(t.withColumn("c", F.struct(*[c for c in t.columns if c != "product"])).select("product", "cyc", "pos", "c"), ["product", "cyc"]).select("bom_ref", "product", "version", F.struct(F.lit(n).alias("source"), "pos").alias("rank"), "c")
        hits = own if hits is None else hits.unionByName(own)
    first = hits.groupBy("bom_ref", "product", "version").agg(F.min_by(F.struct("rank", "c"), "rank").alias("m"))
    return first.select("bom_ref", "product", "version", F.col("m.rank.source").alias("source"), "m.c.*")


def stamped(found: DataFrame, now: Column) -> DataFrame:
    """matched() rows with status and days until the end of life, dates and booleans as they count."""
    status = I.lifecycle_status(F.col("eol"), F.col("eol_flag"), F.col("support"), F.col("support_flag"), F.col("rel"), now)
    return found.withColumns({"status": status, "days_until_eol": I.days_until(F.col("eol"), now), "eol_said": F.coalesce(F.col("eol").cast("string"), F.col("eol_flag")), "support_said": F.coalesce(F.col("support").cast("string"), F.col("support_flag"))})
