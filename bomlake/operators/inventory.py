"""Components: deduplication with ordered merge, edges, candidates, findings, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomlake.functions import identifiers as I
from bomlake.plans.tables import cut


def identity(c: DataFrame) -> Column:
    """The most precise of package URL, CPE name, SHA-256 and type with name and version; else the row itself.

    Nulls count as empty texts; a table without a column for one of them has none. Rows without any never merge.
    """
    has = lambda x: c[x] if x in c.columns else F.lit("")
    known = [
        F.when(c["purl"] != "", F.concat(F.lit("purl:"), I.purl_key(c["purl"]))),
        F.when(F.trim(has("cpe")) != "", F.concat(F.lit("cpe:"), F.lower(F.trim(has("cpe"))))),
        F.when(has("sha256") != "", F.concat(F.lit("sha256:"), F.lower(has("sha256")))),
        F.when((c["name"] != "") & (c["version"] != ""), F.concat(F.lit("nvt:"), F.lower(F.concat_ws(":", c["ctype"], c["name"], c["version"])))),
    ]
    return F.coalesce(*known, F.concat(F.lit("row:"), c["ord"]))


def strength(c: DataFrame) -> Column:
    """How much a component tells (fixed values): a package URL, a CPE name, each place it was found at."""
    has = lambda x, none: F.coalesce(c[x], none) if x in c.columns else none
    return F.when(c["purl"] != "", 100).otherwise(0) + F.when(has("cpe", F.lit("")) != "", 10).otherwise(0) + has("n_locations", F.lit(0)).cast("int")


def deduplicated(components: DataFrame) -> DataFrame:
    """One row a group: the member of the highest score, at the first member's place, with what others add.

    The primary is chosen by aggregation, not by a window, so a group is reduced before the shuffle.
    """
    rank = F.struct(strength(components).alias("score"), (-F.col("ord")).alias("before"))
    kept = F.struct(*[c for c in components.columns])
    return (
        components.withColumn("key", identity(components))
        .groupBy("key")
        .agg(F.max_by(kept, rank).alias("primary"), F.min("ord").alias("place"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("supplier") != "", F.col("supplier")))), ",").alias("suppliers"))
        .select("key", "primary.*", "place", "members", "suppliers")
    )


def pruned_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch a removed reference."""
    gone = removed.select(F.col("bom_ref").alias("gone"))
    return edges.join(gone, edges["src"] == gone["gone"], "left_anti").join(gone, edges["dst"] == gone["gone"], "left_anti")


def grouped_edges(edges: DataFrame) -> DataFrame:
    """Distinct targets of each source; containment isn't written."""
    real = edges.filter("rel not in ('contains', 'unknown')").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    return real.groupBy("src").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


def lifted(nested: DataFrame) -> DataFrame:
    """(parent, child key, ord) -> one row a child with its first parent, one edge a distinct pair."""
    return nested.groupBy("key").agg(F.min_by("parent", "ord").alias("embedded_in"), F.count_distinct("parent").alias("edges"))


def candidates(components: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary hits (by type, namespace and name) and guesses, the highest confidence kept for each CPE."""
    # parsing is most of the work and a small file is one task: rows are dealt out first, by what they are grouped by later
    rows = components.filter("purl <> ''").select("bom_ref", "purl").repartition("bom_ref")
    # a generator parses once; as a plain column each use below would parse again
    parsed = rows.select("bom_ref", F.explode_outer(F.array(I.parse_purl(F.col("purl")))).alias("p")).filter("p is not null").withColumn("g", I.guess_cpe(F.col("p")))
    met = parsed.join(dictionary, (F.lower("p.type") == dictionary["d_type"]) & (F.lower("p.namespace") == dictionary["d_ns"]) & (F.lower("p.name") == dictionary["d_name"]), "left")
    one = lambda vendor, product, confidence, hit: F.struct(F.col(vendor).alias("vendor"), F.col(product).alias("product"), F.lit(confidence).cast("decimal(3,2)").alias("confidence"), F.lit(hit).alias("hit"))
    guess = one("g.vendor", "g.product", 0.70, False)
    both = met.select("bom_ref", "p.version", F.explode(F.when(F.col("d_type").isNotNull(), F.array(one("d_vendor", "d_product", 0.95, True), guess)).otherwise(F.array(guess))).alias("c"))
    found = both.groupBy("bom_ref", I.build_cpe(F.lit("a"), F.col("c.vendor"), F.col("c.product"), F.col("version")).alias("cpe")).agg(F.max("c.confidence").alias("confidence"), F.bool_or("c.hit").alias("hit"), F.bool_or(~F.col("c.hit")).alias("guess"))
    return found.select("bom_ref", "cpe", "confidence", F.concat_ws("+", F.when(F.col("hit"), "dictionary"), F.when(F.col("guess"), "heuristic")).alias("source"))


def classified(found: DataFrame) -> DataFrame:
    """The best of at least 0.70 is primary, others of 0.50 alternatives, the rest rejected."""
    nth = F.row_number().over(Window.partitionBy("bom_ref").orderBy(F.desc("confidence"), "source", "cpe"))
    return found.withColumn("status", F.when((nth == 1) & (F.col("confidence") >= 0.70), "primary").when(F.col("confidence") >= 0.50, "alternative").otherwise("rejected"))


#: Finding rules on a component (fixed values): rule, severity rank by default.
COMPONENT_RULES = {"NTIA-NAME": 4, "NTIA-VERSION": 3, "NTIA-SUPPLIER": 2, "NTIA-IDENTIFIER": 2}
#: Severity policy (fixed values), in order, the last that fits wins: rule, type or '', ecosystem or '', rank.
POLICY = [
    ("NTIA-SUPPLIER", "", "", 2), ("NTIA-SUPPLIER", "file", "", -1), ("NTIA-SUPPLIER", "", "npm", 0), ("NTIA-SUPPLIER", "", "pypi", 0), ("NTIA-SUPPLIER", "", "deb", 0), ("NTIA-SUPPLIER", "", "rpm", 0), ("NTIA-SUPPLIER", "", "apk", 0),
    ("NTIA-SUPPLIER", "", "maven", 1), ("NTIA-SUPPLIER", "", "cargo", 1), ("NTIA-SUPPLIER", "", "gem", 1), ("NTIA-SUPPLIER", "", "nuget", 1), ("NTIA-SUPPLIER", "", "golang", 2), ("NTIA-SUPPLIER", "application", "", 3),
    ("NTIA-VERSION", "", "", 3), ("NTIA-VERSION", "file", "", -1), ("NTIA-VERSION", "application", "", 4),
    ("NTIA-IDENTIFIER", "", "", 3), ("NTIA-IDENTIFIER", "file", "", -1), ("NTIA-NAME", "", "", 4),
]


def findings(components: DataFrame) -> DataFrame:
    """A row for each rule that a component other than a file breaks; a CPE name identifies it, too, and an author stands for a supplier."""
    has = lambda c: F.col(c) != "" if c in components.columns else F.lit(False)
    broken = {"NTIA-NAME": F.col("name") == "", "NTIA-VERSION": F.col("version") == "", "NTIA-SUPPLIER": ~(has("supplier") | has("author")), "NTIA-IDENTIFIER": ~(has("purl") | has("cpe"))}
    rules = F.filter(F.array(*[F.when(broken[r], F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("raw"))) for r, s in COMPONENT_RULES.items()]), lambda r: r.isNotNull())
    return components.filter("ctype <> 'file'").withColumn("f", F.explode(rules)).select("bom_ref", "ord", "ctype", I.ecosystem(F.col("purl")).alias("eco"), "f.*")


def with_policy(found: DataFrame, extra: list[tuple] = ()) -> DataFrame:
    """Severity by the last fitting rule of the policy and of operator overrides after it, as one expression."""
    out = F.col("raw")
    for rule, ctype, eco, rank in [*POLICY, *extra]:
        fits = F.lit(True)
        for column, value in (("rule_id", rule), ("ctype", ctype), ("eco", eco)):
            fits = fits & (F.col(column) == value) if value else fits
        out = F.when(fits, rank).otherwise(out)
    return found.withColumn("severity", out)


def rollup(found: DataFrame) -> DataFrame:
    """Counts by rule; a status is a validator's, see compliance.statuses()."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 2).alias("actionable"), F.max("severity").alias("worst"))


def repeated_refs(refs: DataFrame, key: str = "dst") -> DataFrame:
    """References that occur more than once, with how often beyond the first."""
    return refs.groupBy(key).agg((F.count("*") - 1).alias("repeats")).filter("repeats > 0")


def levels(edges: DataFrame) -> DataFrame:
    """(name, dep) of a DAG -> (name, level): 0 without dependencies, else one more than the highest dependency.

    A round a level, however many there are. Each takes the edges to the last level's names away and looks only at what is left, so an edge is
    carried until its dependency is known and never joined to names of earlier levels. A cycle raises an error, an empty table has no rows.
    """
    left = cut(edges.select("name", "dep").distinct())
    frontier = cut(left.select(F.col("dep").alias("name")).distinct().join(left.select("name").distinct(), "name", "left_anti"))
    found, level = frontier.withColumn("level", F.lit(0)), 0
    while not frontier.isEmpty():
        rest = cut(left.join(frontier.select(F.col("name").alias("dep")), "dep", "left_anti"))
        # names that lost their last edge
        frontier = cut(left.select("name").distinct().join(rest.select("name").distinct(), "name", "left_anti"))
        left, level = rest, level + 1
        found = found.unionByName(frontier.withColumn("level", F.lit(level)))
    if not left.isEmpty():
        raise ValueError("the dependencies have a cycle")
    return found
