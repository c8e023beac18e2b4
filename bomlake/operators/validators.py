"""Validators: documents and their components -> findings (sbom_id, validator, rule_id, severity, bom_ref).

Documents: sbom_id, author, created. Components: sbom_id, ord, bom_ref, ctype, name, purl, n_licences,
cpe_source, disclosure. '' stands for absent; a finding on a whole document has an empty bom_ref.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import paths as P

#: Component types that CycloneDX knows (fixed values).
TYPES = ("application", "container", "device", "file", "firmware", "framework", "library", "operating-system", "platform", "unknown")
#: Frameworks whose licence matters (fixed values): types and ecosystems.
FRAMEWORK_TYPES, FRAMEWORK_PURLS = ("framework", "application"), "^pkg:(maven|helm|pypi|npm)/"
#: CPE sources that count as authoritative (fixed values).
AUTHORITIES = ("nvd-api", "clearly-defined")
#: Components from which a document without edges is a finding.
MANY = 10


def outside_files(components: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Components with `place` (like /0/1) -> those that are neither files nor nested in one.

    of: rows of the components, with the columns that are asked for; only these are judged and given.
    """
    of = components if of is None else of
    files = components.filter("ctype = 'file'").select("sbom_id", F.col("place").alias("up"))
    up = of.select("sbom_id", "place", F.explode(F.array_append(P.ancestors(F.col("place")), F.col("place"))).alias("up"))
    inside = up.join(files, ["sbom_id", "up"]).select("sbom_id", "place").distinct()
    return of.join(inside, ["sbom_id", "place"], "left_anti")


def on_components(components: DataFrame, validator: str, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """A row for each rule that a component breaks."""
    broken = F.filter(F.array(*[F.when(test, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, test in rules]), lambda r: r.isNotNull())
    return components.select("sbom_id", F.lit(validator).alias("validator"), "bom_ref", F.explode(broken).alias("f")).select("sbom_id", "validator", "f.rule_id", "f.severity", "bom_ref")


def on_documents(documents: DataFrame, validator: str, rules: list[tuple[str, int, Column]]) -> DataFrame:
    return on_components(documents.withColumn("bom_ref", F.lit("")), validator, rules)


def totals(documents: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with their numbers of components, edges and components that lead to vulnerabilities."""
    n = components.groupBy("sbom_id").agg(F.count("*").alias("n"), F.count_if((F.col("disclosure") != "") | F.col("cpe_source").isin(*AUTHORITIES)).alias("handled"))
    e = edges.groupBy("sbom_id").agg(F.count("*").alias("edges"))
    return documents.join(n, "sbom_id", "left").join(e, "sbom_id", "left").fillna(0, ["n", "handled", "edges"])


def ntia_documents(counted: DataFrame) -> DataFrame:
    return on_documents(counted, "ntia", [("NTIA-METADATA-AUTHOR", 3, F.col("author") == ""), ("NTIA-METADATA-TIMESTAMP", 3, F.col("created") == ""), ("NTIA-RELATIONSHIPS", 2, (F.col("n") >= MANY) & (F.col("edges") == 0))])


def unlicensed() -> Column:
    """Frameworks without a licence."""
    return F.col("ctype").isin(*FRAMEWORK_TYPES) & F.col("purl").rlike(FRAMEWORK_PURLS) & (F.col("n_licences") == 0)


def eu_cra(counted: DataFrame, components: DataFrame) -> DataFrame:
    """Components: those outside files."""
    return on_documents(counted, "eu-cra", [("EU-CRA-ART13-VULN-HANDLING", 2, F.col("handled") == 0)]).unionByName(on_components(components, "eu-cra", [("EU-CRA-ART13-LICENSE", 1, unlicensed())]))


def cyclonedx(counted: DataFrame, components: DataFrame) -> DataFrame:
    own = [("CDX-COMPONENT-NAME-MISSING", 4, F.col("name") == ""), ("CDX-COMPONENT-TYPE-INVALID", 3, ~F.col("ctype").isin(*TYPES))]
    # references are counted before the shuffle; those of one place each have nothing to join
    firsts = components.filter("bom_ref <> ''").groupBy("sbom_id", "bom_ref").agg(F.min("ord").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    again = components.join(firsts, ["sbom_id", "bom_ref"]).filter("ord > first")
    return on_documents(counted, "cyclonedx", [("CDX-EMPTY-COMPONENTS", 3, F.col("n") == 0)]).unionByName(on_components(components, "cyclonedx", own)).unionByName(on_components(again, "cyclonedx", [("CDX-BOMREF-DUPLICATE", 3, F.lit(True))]))


def spdx(counted: DataFrame, components: DataFrame) -> DataFrame:
    own = [("SPDX-PACKAGE-NAME-MISSING", 4, F.col("name") == ""), ("SPDX-DOWNLOAD-LOCATION-NOASSERTION", 1, F.col("purl") == ""), ("SPDX-LICENSE-NOASSERTION", 1, F.col("n_licences") == 0)]
    return on_documents(counted, "spdx", [("SPDX-EMPTY-PACKAGES", 3, F.col("n") == 0)]).unionByName(on_components(components, "spdx", own))
