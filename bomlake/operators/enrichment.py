"""Lifecycle and registry enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I


def matched_cycles(components: DataFrame, cycles: DataFrame, now: Column) -> DataFrame:
    """(bom_ref, product, version, form), (product, cyc, pos, rel, support, eol) -> the first cycle that fits, with status.

    A cycle fits if it is the version in the product's form, with or without a leading v.
    """
    form = F.col("form")
    version = F.when(form == "major", F.substring_index("version", ".", 1)).when(form == "major.minor", F.substring_index("version", ".", 2)).otherwise(F.col("version"))
    wanted = components.withColumn("cyc", F.explode(F.array_distinct(F.array(version, F.regexp_replace(version, "^v", "")))))
    first = cycles.groupBy("product", "cyc").agg(F.min(F.struct("pos", "rel", "support", "eol")).alias("c"))
    hit = wanted.join(first, ["product", "cyc"]).groupBy("bom_ref", "product").agg(F.min_by(F.struct("cyc", "c"), "c.pos").alias("m")).select("bom_ref", "product", "m.cyc", "m.c")
    no = F.lit("")
    return hit.select("bom_ref", "product", "cyc", I.lifecycle_status(F.col("c.eol"), no, F.col("c.support"), no, F.col("c.rel"), now).alias("status"), I.days_until(F.col("c.eol"), now).alias("days_until_eol"))


def filled(components: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fills only what is empty from the metadata of a component's canonical key; tells what was filled."""
    m = metadata.groupBy("purl_key").agg(F.min_by(F.struct("supplier", "licence"), "ord").alias("m"))
    keyed = components.withColumn("purl_key", F.when(F.col("purl") != "", I.purl_key(F.col("purl"))))
    joined = keyed.join(m, "purl_key", "left")
    supplier = F.when(F.col("supplier") != "", F.col("supplier")).otherwise(F.coalesce("m.supplier", F.lit("")))
    return joined.select("bom_ref", supplier.alias("supplier"), F.coalesce("m.licence", F.lit("")).alias("licence"), ((F.col("supplier") == "") & (supplier != "")).alias("filled"))


def outcomes(attempts: DataFrame) -> DataFrame:
    """(request, ord, status) -> request, outcome, endpoint: of the endpoints asked in order, the first that answers counts.

    Without an answer the outcome is the gravest: an error (other statuses, and null where none came), a passing
    failure (429, 500 and above), not found (404). `endpoint` is the ord of the answer, null without one.
    """
    status = F.col("status")
    rank = F.when(status == 200, 4).when(status == 404, 1).when((status == 429) | (status >= 500), 2).otherwise(3)
    ranked = attempts.groupBy("request").agg(F.max(rank).alias("rank"), F.min(F.when(status == 200, F.col("ord"))).alias("endpoint"))
    return ranked.select("request", F.element_at(F.array(*map(F.lit, ["not-found", "transient", "error", "found"])), F.col("rank")).alias("outcome"), "endpoint")


def with_licences(own: Column, more: Column) -> Column:
    """Arrays of struct(id, name, url, expression): `own`, and those of `more` that it lacks by id, expression or name.

    Licences without id and name go; one that a former one of `more` equals goes, too. Null arrays count as empty.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    same = lambda a, b: ((blank(b["id"]) != "") & ((blank(a["id"]) == b["id"]) | (blank(a["expression"]) == b["id"]))) | ((blank(b["name"]) != "") & (blank(a["name"]) == b["name"]))
    known = lambda kept, b: (F.concat(blank(b["id"]), blank(b["name"])) == "") | F.exists(kept, lambda a: same(a, b))
    return folded(own, more, "array<struct<id:string,name:string,url:string,expression:string>>", known, lambda b: b)


def with_hashes(own: Column, more: Column) -> Column:
    """Arrays of struct(algorithm, value): `own`, and those of `more` whose algorithm it lacks, by normal names."""
    named = lambda b: F.struct(I.hash_algorithm(b["algorithm"]).alias("algorithm"), b["value"].alias("value"))
    known = lambda kept, b: (F.coalesce(b["algorithm"], F.lit("")) == "") | (F.coalesce(b["value"], F.lit("")) == "") | F.exists(kept, lambda a: a["algorithm"] == I.hash_algorithm(b["algorithm"]))
    return folded(own, more, "array<struct<algorithm:string,value:string>>", known, named)


def folded(own: Column, more: Column, kind: str, known, made) -> Column:
    """`own` and, one after another, made(x) of each x of `more` for which known(what there is, x) doesn't hold."""
    own, more = (F.coalesce(c, F.array()).cast(kind) for c in (own, more))
    return F.aggregate(more, own, lambda kept, x: F.when(known(kept, x), kept).otherwise(F.concat(kept, F.array(made(x))).cast(kind)))
