"""Deduplication of whole records: one a group of equal components, the primary with what the others add.

Groups are those of inventory.identity(), the primary is the strongest member, at the place of the first; the others follow in order of `ord`.
What is added is unioned as rows, so a group of many members with few different values is never gathered; a record gets its distinct
values only. A component alone stays as it is. Nulls count as empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.operators import inventory, merging
from bomlake.plans.tables import cut

#: What properties of merged records start with.
NOTE = "bom:dedup:"
LICENCE = "array<struct<id:string,name:string,expression:string,url:string>>"


def ranked(components: DataFrame) -> DataFrame:
    """Components with key, primary (of its group), members (of the group), first (the group's least ord) and rank: the primary's is the least, others follow by ord."""
    keyed = components.withColumn("key", inventory.identity(components)).withColumn("strength", inventory.strength(components))
    groups = keyed.groupBy("key").agg(F.max_by("ord", F.struct("strength", (-F.col("ord")).alias("before"))).alias("chosen"), F.count("*").alias("members"), F.min("ord").alias("first"))
    rows = keyed.join(groups, "key").withColumn("primary", F.col("ord") == F.col("chosen"))
    return rows.withColumn("rank", F.struct((~F.col("primary")).alias("after"), F.col("ord").alias("ord"))).drop("strength", "chosen")


def listed(rows: DataFrame, name: str) -> DataFrame:
    """(key, item, rank, pos) -> key and the array of items in order."""
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "item"))), lambda x: x["item"]).alias(name))


def folded(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def merged(records: DataFrame) -> DataFrame:
    """Records (ord and the columns of sources.records.RECORD) -> those that stay, in order of `first`, with key and members.

    Locations are the same by path, hashes by algorithm and value, CPE names and licences by what they say in lower case; of equal ones the first stays.
    A property's first value stays, the last other one is noted as a conflict; so is the last other layer; method and confidence are the first that are stated.
    """
    strong = records.withColumns({"cpe": F.coalesce(F.get(F.filter(F.coalesce("cpes", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), F.lit(0)), F.lit("")), "sha256": F.coalesce(F.get(F.filter("hashes", lambda h: h["alg"] == "sha256"), F.lit(0))["value"], F.lit("")), "n_locations": F.coalesce(F.when(F.col("evidence").isNotNull(), F.size("evidence.locations")), F.lit(0))})
    rows = cut(ranked(strong))  # read by each of the unions below
    several = rows.filter("members > 1").select("key", "rank", "primary", "cpes", "hashes", "licences", "evidence", "layer", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), F.coalesce("evidence.locations", F.array().cast("array<string>")).alias("locations"))
    hash_key = F.when(F.coalesce(F.col("item.value"), F.lit("")) != "", F.concat_ws(":", F.lower("item.alg"), F.lower("item.value")))
    by_name = F.concat_ws("|", folded(F.col("item.id")), folded(F.col("item.name")))
    licence_key = F.when(folded(F.col("item.expression")) != "", folded(F.col("item.expression"))).when(by_name != "|", by_name)
    unions = [
        listed(merging.union(several, "cpes", folded(F.col("item"))), "u_cpes"), listed(merging.union(several, "hashes", hash_key), "u_hashes"),
        listed(merging.union(several, "licences", licence_key), "u_licences"), listed(merging.union(several, "locations", F.concat(F.lit("/"), "item")), "u_locations"),
    ]
    props = merging.properties(several).withColumn("name", F.when(F.col("name").startswith("conflict:"), F.concat(F.lit(NOTE), "name")).otherwise(F.col("name")))
    props = props.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("u_props"))
    layers = merging.other_layer(several.select("key", "rank", F.col("layer.index").alias("layer"))).select("key", "also_in_layer", "merged")
    stated = several.groupBy("key").agg(
        F.min_by("layer", F.when(F.col("layer").isNotNull(), F.col("rank"))).alias("u_layer"), F.max(F.col("evidence").isNotNull()).alias("has"),
        F.min_by("evidence.method", F.when(F.coalesce("evidence.method", F.lit("")) != "", F.col("rank"))).alias("u_method"), F.min_by("evidence.confidence", F.when(F.coalesce("evidence.confidence", F.lit(0.0)) != 0, F.col("rank"))).alias("u_confidence"),
    )
    out = rows.filter("primary")
    for part in (*unions, props, layers, stated):
        out = out.join(part, "key", "left")
    more = F.col("members") > 1
    own = F.coalesce("evidence.locations", F.array().cast("array<string>"))
    evidence = F.when(F.col("has"), F.struct(F.coalesce("u_method", F.lit("")).alias("method"), F.coalesce("u_confidence", F.lit(0.0)).cast("float").alias("confidence"), F.concat(own, F.filter(F.coalesce("u_locations", F.array().cast("array<string>")), lambda p: ~F.array_contains(own, p))).alias("locations")))
    kept = lambda c, kind: F.when(more, F.coalesce(f"u_{c}", F.array().cast(kind))).otherwise(F.col(c))
    said = F.filter(F.array(F.struct(F.lit(NOTE + "merged-count").alias("key"), F.col("merged").cast("string").alias("value")), F.when(F.col("also_in_layer").isNotNull(), F.struct(F.lit(NOTE + "also-in-layer").alias("key"), F.col("also_in_layer").cast("string").alias("value")))), lambda x: x.isNotNull())
    notes = F.map_from_entries(said)
    plain = F.map_filter(F.coalesce("u_props", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(notes), k))
    return out.select(
        "key", "members", "first", *[c for c in records.columns if c not in ("cpes", "hashes", "licences", "evidence", "props", "layer")],
        kept("cpes", "array<string>").alias("cpes"), kept("hashes", "array<struct<alg:string,value:string>>").alias("hashes"), kept("licences", LICENCE).alias("licences"),
        F.when(more, evidence).otherwise(F.col("evidence")).alias("evidence"), F.when(more, F.map_concat(plain, notes)).otherwise(F.col("props")).alias("props"), F.when(more, F.col("u_layer")).otherwise(F.col("layer")).alias("layer"),
    )
