"""Compliance of documents: findings of all validators, severities by policy, status by validator, what is stamped, the gate.

Findings are rows (sbom_id, validator, rule_id, severity, bom_ref); '' as reference means the document. Components have sbom_id, place (sorts in
the order of a walk down the tree), bom_ref, ctype, name, version, purl, supplier, author, cpe. Nulls count as ''; empty tables give no findings, and
a document without any passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.operators import inventory, validators
from bomlake.plans.tables import cut

#: Severity policy for findings on documents, SPDX and the EU's act (fixed values): as inventory.POLICY, which comes first.
FURTHER = [
    ("NTIA-METADATA-AUTHOR", "", "", 3), ("NTIA-METADATA-TIMESTAMP", "", "", 3), ("NTIA-RELATIONSHIPS", "", "", 2),
    ("SPDX-LICENSE-NOASSERTION", "", "", 1), ("SPDX-LICENSE-NOASSERTION", "file", "", -1), ("SPDX-DOWNLOAD-LOCATION-NOASSERTION", "", "", 1), ("SPDX-DOWNLOAD-LOCATION-NOASSERTION", "file", "", -1),
    ("SPDX-PACKAGE-NAME-MISSING", "", "", 4), ("SPDX-EMPTY-PACKAGES", "", "", 3),
    ("EU-CRA-ART13-VULN-HANDLING", "", "", 2), ("EU-CRA-ART13-LICENSE", "", "", 1), ("EU-CRA-ART13-LICENSE", "file", "", -1),
]
#: Ranks from which a finding asks for action, and from which a validator fails (fixed values).
ACTIONABLE, FAILS = 2, 3
#: Keys of what is stamped on a document, after the library's prefix.
COUNTS = {"findings-count": None, "actionable-findings-count": None, "critical-count": 4, "high-count": 3, "medium-count": 2, "low-count": 1, "info-count": 0}
STAMP = "bom:compliance:"


def said(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def ntia(counted: DataFrame, components: DataFrame) -> DataFrame:
    """The minimum elements: of documents, and of components that are neither files nor within one."""
    absent = lambda c: said(F.col(c)) == ""
    broken = {"name": absent("name"), "version": absent("version"), "supplier": absent("supplier") & absent("author"), "identifier": absent("purl") & absent("cpe")}
    # rows that break no rule, and texts that the rules have read, aren't carried through the joins
    rows = components.select("sbom_id", "place", "bom_ref", *[test.alias(c) for c, test in broken.items()]).filter(" OR ".join(broken))
    c = validators.outside_files(components, rows)
    rules = [("NTIA-NAME", 4, F.col("name")), ("NTIA-VERSION", 3, F.col("version")), ("NTIA-SUPPLIER", 2, F.col("supplier")), ("NTIA-IDENTIFIER", 2, F.col("identifier"))]
    return validators.ntia_documents(counted).unionByName(validators.on_components(c, "ntia", rules))


def named(components: DataFrame) -> DataFrame:
    """sbom_id, bom_ref, ctype, eco: the first component of each reference on a walk down the tree."""
    first = F.min(F.struct("place", said(F.col("ctype")).alias("ctype"), I.ecosystem(said(F.col("purl"))).alias("eco")))
    return components.filter(said(F.col("bom_ref")) != "").groupBy("sbom_id", "bom_ref").agg(first.alias("c")).select("sbom_id", "bom_ref", "c.ctype", "c.eco")


def judged(findings: DataFrame, components: DataFrame, overrides: list[tuple] = ()) -> DataFrame:
    """Findings with the severity that the policy and then the overrides give, those that it ignores left out.

    A rule of a type or an ecosystem fits only findings whose reference names a component; rules that nobody states keep their severity.
    """
    rows = findings.join(named(components), ["sbom_id", "bom_ref"], "left").withColumnRenamed("severity", "raw")
    rows = rows.fillna("", ["ctype", "eco"])
    ranked = inventory.with_policy(rows, [*FURTHER, *overrides])
    return ranked.filter("severity >= 0").select("sbom_id", "validator", "rule_id", "severity", "bom_ref")


def statuses(documents: DataFrame, found: DataFrame, ran: list[str], errored: DataFrame | None = None) -> DataFrame:
    """sbom_id, validator, status of every validator that ran: errored, failed, passed-with-warnings or passed."""
    every = documents.select("sbom_id").distinct().select("sbom_id", F.explode(F.array(*map(F.lit, ran))).alias("validator"))
    worst = found.groupBy("sbom_id", "validator").agg(F.max("severity").alias("worst"))
    rows = every.join(worst, ["sbom_id", "validator"], "left")
    broke = F.lit(False)
    if errored is not None:
        rows = rows.join(errored.select("sbom_id", "validator", F.lit(True).alias("broke")).distinct(), ["sbom_id", "validator"], "left")
        broke = F.coalesce(F.col("broke"), F.lit(False))
    status = F.when(broke, "errored").when(F.col("worst") >= FAILS, "failed").when(F.col("worst").isNotNull(), "passed-with-warnings").otherwise("passed")
    return rows.select("sbom_id", "validator", status.alias("status"))


def stamps(documents: DataFrame, found: DataFrame, status: DataFrame) -> DataFrame:
    """sbom_id and a map of properties: each validator's status, and counts of findings."""
    of = lambda rank: F.count_if(F.col("severity") == rank)
    counts = {k: F.count("*") if k == "findings-count" else F.count_if(F.col("severity") >= ACTIONABLE) if rank is None else of(rank) for k, rank in COUNTS.items()}
    n = found.groupBy("sbom_id").agg(*[c.alias(k) for k, c in counts.items()])
    s = status.groupBy("sbom_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(STAMP), "validator", F.lit(":status")), "status"))).alias("own"))  # a few validators a document
    rows = documents.select("sbom_id").distinct().join(n, "sbom_id", "left").join(s, "sbom_id", "left")
    numbers = F.create_map(*[x for k in COUNTS for x in (F.lit(STAMP + k), F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("string"))])
    return rows.select("sbom_id", F.map_concat(F.coalesce("own", F.create_map().cast("map<string,string>")), numbers).alias("props"))


def component_stamps(found: DataFrame, components: DataFrame) -> DataFrame:
    """sbom_id, place, key, value: a property for every rule that a component breaks, on the first of its reference; of equal rules the last finding's severity, the validators in order of name."""
    first = components.filter(said(F.col("bom_ref")) != "").groupBy("sbom_id", "bom_ref").agg(F.min("place").alias("place"))
    last = found.filter("bom_ref <> ''").groupBy("sbom_id", "bom_ref", "rule_id").agg(F.max_by("severity", F.struct("validator", "severity")).alias("severity"))
    return last.join(first, ["sbom_id", "bom_ref"]).select("sbom_id", "place", F.concat(F.lit(STAMP + "finding:"), "rule_id").alias("key"), I.severity_name(F.col("severity")).alias("value"))


def gate(documents: DataFrame, found: DataFrame, floor: str) -> DataFrame:
    """sbom_id, hits, failed: findings of the floor's rank or more. An unknown floor raises ValueError."""
    rank = I.SEVERITIES.get(floor.strip().lower())
    if rank is None:
        raise ValueError(f"unknown severity {floor!r}")
    hits = found.filter(F.col("severity") >= rank).groupBy("sbom_id").agg(F.count("*").alias("hits"))
    return documents.select("sbom_id").distinct().join(hits, "sbom_id", "left").select("sbom_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNotNull().alias("failed"))


def findings(documents: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings of all validators, as they emit them. Documents and components have the columns that validators take, too."""
    counted = validators.totals(documents, components, edges)
    outside = validators.outside_files(components, components.filter(validators.unlicensed()).select("sbom_id", "place", "bom_ref", "ctype", "purl", "n_licences"))
    parts = [ntia(counted, components), validators.eu_cra(counted, outside), validators.cyclonedx(counted, components), validators.spdx(counted, components)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placed(nodes: DataFrame) -> DataFrame:
    """(sbom_id, node, parent or null, ord) -> with `place`, which sorts as a walk down the tree does: parents first, siblings by `ord`.

    Ways up are doubled each round, so a depth of n takes log n joins, and only nodes whose way isn't known yet take part. A round that
    settles no node leaves only cycles, and what hangs on them; these, and nodes whose way up leads to a node that is not there, are left out.
    """
    # ways without places first, as those of cycles would grow
    sound = climbed(nodes.select("sbom_id", "node", F.col("parent").alias("up")).distinct()).select("sbom_id", "node")
    rows = climbed(nodes.join(sound, ["sbom_id", "node"]).select("sbom_id", "node", F.col("parent").alias("up"), F.format_string("/%08d", "ord").alias("place")), "place")
    return nodes.join(rows.select("sbom_id", "node", "place"), ["sbom_id", "node"])


def climbed(rows: DataFrame, *texts: str) -> DataFrame:
    """(sbom_id, node, up, texts) -> the rows whose way up ends, with up null, and their texts after those of all nodes above."""
    rows = cut(rows)
    done, left = rows.filter("up IS NULL"), rows.filter("up IS NOT NULL")
    n = left.count()
    for _ in range(n.bit_length() + 1):
        if not n:
            break
        above = done.unionByName(left).select("sbom_id", F.col("node").alias("up"), F.col("up").alias("further"), *[F.col(c).alias(f"above_{c}") for c in texts])
        met = cut(left.join(above, ["sbom_id", "up"]).select("sbom_id", "node", F.col("further").alias("up"), *[F.concat(f"above_{c}", c).alias(c) for c in texts]))
        done, left = done.unionByName(met.filter("up IS NULL")), met.filter("up IS NOT NULL")
        before, n = n, left.count()
        if n == before:
            break
    return done
