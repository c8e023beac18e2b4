"""CPE names of a snapshot table as candidates for components: keyword join, version sieve, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.plans.tables import cut

#: Shares of a match (fixed values): vendor, product, version.
VENDOR = {"exact": 0.50, "normalised": 0.40, "part": 0.10}
PRODUCT = {"exact": 0.40, "normalised": 0.30, "segment": 0.20, "part": 0.10}
RELEASE = {"exact": 0.20, "wildcard": 0.10, "unpinned": 0.05}
#: Hardware on software, and the least score that isn't rejected (fixed values).
REJECTED, LEAST = 0.05, 0.30
WORD = "[^a-z0-9]+"


def share(value: float) -> Column:
    return F.lit(value).cast("decimal(3,2)")


def plain(value: Column) -> Column:
    return F.translate(value, "-.", "__")


def same(a: Column, b: Column, form=lambda x: x) -> Column:
    return (a != "") & (b != "") & (form(a) == form(b))


def overlaps(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def vendor_share(vendor: Column, namespace: Column, name: Column) -> Column:
    rules = [(same, "exact"), (lambda a, b: same(a, b, plain), "normalised"), (overlaps, "part")]
    return F.coalesce(*[F.when(test(vendor, namespace) | test(vendor, name), share(VENDOR[k])) for test, k in rules], share(0.0))


def product_share(product: Column, namespace: Column, name: Column) -> Column:
    segment = F.regexp_extract(namespace, "([^/.]*)$", 1)
    rules = [(same(product, name), "exact"), (same(product, name, plain), "normalised"), ((namespace != "") & same(product, segment) & (name != ""), "segment"), (overlaps(product, name), "part")]
    return F.coalesce(*[F.when(test, share(PRODUCT[k])) for test, k in rules], share(0.0))


def release_share(found: Column, wanted: Column) -> Column:
    return F.when(wanted == "", share(RELEASE["unpinned"])).when(found == wanted, share(RELEASE["exact"])).when(found.isin("*", "-", ""), share(RELEASE["wildcard"])).otherwise(share(0.0))


def words_of(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(value), WORD), lambda w: w != ""))


def rarest_word(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """name, word: of each name's words the one that the fewest CPE names have, the first in order on a tie; none where a word is in no CPE name."""
    counts = own.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = wanted.select("name").distinct().select("name", F.explode(words_of(F.col("name"))).alias("word")).join(counts, "word", "left")
    least = each.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("m"))
    return least.filter("m.n > 0").select("name", F.col("m.word").alias("word"))


def searched(components: DataFrame, names: DataFrame) -> DataFrame:
    """(bom_ref, purl), (cpe) -> bom_ref, cpe, score, rejected ('' or why) of names with all words of the component's name.

    Each different package is searched once, by the word of its name that the fewest CPE names have, so a word that very many
    have is joined only by names that have no other; the rest is tested on what that finds. Names that pin another version are
    left out; malformed names, package URLs and names without a word give nothing.
    """
    parts = F.split("cpe", ":")
    own = names.filter(I.cpe_valid(F.col("cpe"))).select("cpe", parts[2].alias("part"), F.lower(parts[3]).alias("vendor"), F.lower(parts[4]).alias("product"), parts[5].alias("release")).distinct()
    own = own.withColumn("words", words_of(F.concat_ws("_", "vendor", "product")))
    wanted = components.filter("purl <> ''").select("bom_ref", F.explode(F.array(I.parse_purl(F.col("purl")))).alias("p")).filter("p is not null")
    wanted = wanted.select("bom_ref", F.lower("p.namespace").alias("ns"), F.lower("p.name").alias("name"), F.col("p.version").alias("version"))
    wanted, own = cut(wanted), cut(own)
    # words are compared once for each different name and list of words; versions are a key, so a package meets those names only that it gets
    lists = own.select("words").distinct().withColumn("word", F.explode("words"))
    fitting = rarest_word(wanted, own).join(lists, "word").filter(F.size(F.array_except(words_of(F.col("name")), F.col("words"))) == 0).select("name", "words")
    found = cut(fitting.join(own, "words").drop("words"))
    once = wanted.select("ns", "name", "version").distinct()
    pinned = once.filter("version <> ''").withColumn("release", F.explode(F.array_distinct(F.array(F.col("version"), *map(F.lit, ("*", "-", "")))))).join(found, ["name", "release"])
    fits = pinned.unionByName(once.filter("version = ''").join(found, "name"))
    fits = fits.repartition(int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ns", "name", "version")  # few bytes, much to score
    total = vendor_share(F.col("vendor"), F.col("ns"), F.col("name")) + product_share(F.col("product"), F.col("ns"), F.col("name")) + release_share(F.col("release"), F.col("version"))
    score = F.when(F.col("part") == "h", share(REJECTED)).otherwise(F.least(total, share(1.0)).cast("decimal(3,2)"))
    scored = wanted.join(fits.select("ns", "name", "version", "cpe", "part", score.alias("score")), ["ns", "name", "version"])
    return scored.select("bom_ref", "cpe", "score", F.when(F.col("part") == "h", "hardware").when(F.col("score") < LEAST, "weak").otherwise("").alias("rejected"))
