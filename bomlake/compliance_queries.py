"""Queries of compliance: findings of all validators after the policy, status by validator, stamps, the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.operators import compliance, inventory
from bomlake.queries import C, query, view

#: Documents of groups of ten components: a head, four below it, two below the first of these, three beside. Of the heads some are files.
GROUP = "CAST(floor(ord / 10) AS BIGINT)"
NTH = "ord % 10"
HEADED = "lpad(CAST({0} AS {{t}}), 8, '0')"
PLACE = f"concat('/', {HEADED.format(GROUP + ' * 4')}, CASE WHEN {NTH} = 0 THEN '' WHEN {NTH} < 5 THEN concat('/', {HEADED.format(NTH)}) WHEN {NTH} < 7 THEN concat('/00000001/', {HEADED.format(NTH)}) ELSE '' END)"
PLACE = f"CASE WHEN {NTH} > 6 THEN concat('/', {HEADED.format(f'{GROUP} * 4 + {NTH} - 6')}) ELSE {PLACE} END"
ITEMS = f"SELECT concat('bom-', {GROUP} % 7 + 1) AS sbom_id, ord, {PLACE} AS place, CASE WHEN ord % 50 = 3 THEN 'part-7' WHEN ord % 53 = 4 THEN '' ELSE bom_ref END AS bom_ref, CASE WHEN ord % 23 = 0 THEN 'odd' WHEN ord % 40 = 11 THEN 'file' ELSE ctype END AS ctype, CASE WHEN ord % 29 = 0 THEN '' ELSE name END AS name, version, supplier, CASE WHEN ord % 4 = 1 THEN 'someone' ELSE '' END AS author, purl, cpe, CASE WHEN ord % 4 = 0 THEN 0 ELSE 1 END AS n_licences, CASE WHEN ord % 10 = 2 AND {GROUP} % 7 = 2 THEN 'nvd-api' ELSE '' END AS cpe_source, '' AS disclosure FROM {{0}}"
BOMS = "SELECT concat('bom-', s_suppkey) AS sbom_id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END AS author, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2000-01-01' END AS created FROM {0}"
RAN = ["ntia", "eu-cra", "cyclonedx", "spdx"]
OVERRIDES = [("NTIA-VERSION", "library", "", 1), ("NTIA-RELATIONSHIPS", "", "", 0)]


def bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    view(spark, sf_dir, "components").createOrReplaceTempView("bomlake_components")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("bomlake_suppliers")
    documents, items = spark.sql(BOMS.format("bomlake_suppliers")), spark.sql(ITEMS.format("bomlake_components", t="string"))
    return documents, items, documents.filter("sbom_id = 'bom-1'").select("sbom_id")


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, components, findings after policy and overrides."""
    documents, items, edges = bills(spark, sf_dir)
    return documents, items, compliance.judged(compliance.findings(documents, items, edges), items, OVERRIDES)


ROW = "SELECT sbom_id, '{0}' AS validator, '{1}' AS rule_id, {2} AS raw, {3} AS bom_ref FROM {4} WHERE {5}"
DOC = [("ntia", "NTIA-METADATA-AUTHOR", 3, "author = ''"), ("ntia", "NTIA-METADATA-TIMESTAMP", 3, "created = ''"), ("ntia", "NTIA-RELATIONSHIPS", 2, "n >= 10 AND edges = 0"), ("eu-cra", "EU-CRA-ART13-VULN-HANDLING", 2, "handled = 0"), ("cyclonedx", "CDX-EMPTY-COMPONENTS", 3, "n = 0"), ("spdx", "SPDX-EMPTY-PACKAGES", 3, "n = 0")]
OUT = [("ntia", "NTIA-NAME", 4, "name = ''"), ("ntia", "NTIA-VERSION", 3, "version = ''"), ("ntia", "NTIA-SUPPLIER", 2, "supplier = '' AND author = ''"), ("ntia", "NTIA-IDENTIFIER", 2, "purl = '' AND cpe = ''"), ("eu-cra", "EU-CRA-ART13-LICENSE", 1, "ctype IN ('framework', 'application') AND regexp_matches(purl, '^pkg:(maven|helm|pypi|npm)/') AND n_licences = 0")]
ALL = [("cyclonedx", "CDX-COMPONENT-NAME-MISSING", 4, "name = ''"), ("cyclonedx", "CDX-COMPONENT-TYPE-INVALID", 3, "ctype = 'odd'"), ("cyclonedx", "CDX-BOMREF-DUPLICATE", 3, "bom_ref <> '' AND nth > 1"), ("spdx", "SPDX-PACKAGE-NAME-MISSING", 4, "name = ''"), ("spdx", "SPDX-DOWNLOAD-LOCATION-NOASSERTION", 1, "purl = ''"), ("spdx", "SPDX-LICENSE-NOASSERTION", 1, "n_licences = 0")]
POLICY = "CASE " + " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in (("rule_id", r), ("ctype", t), ("eco", e)) if v) + f" THEN {s}" for r, t, e, s in reversed([*inventory.POLICY, *compliance.FURTHER, *OVERRIDES])) + " ELSE raw END"
JUDGED = (
    f"WITH d AS ({BOMS.format('supplier')}), i AS ({ITEMS.format(C, t='VARCHAR')}), files AS (SELECT sbom_id, place FROM i WHERE ctype = 'file'), "
    "outside AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.sbom_id = i.sbom_id AND (i.place = f.place OR starts_with(i.place, concat(f.place, '/'))))), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY sbom_id, bom_ref ORDER BY ord) AS nth FROM i), "
    "counted AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(handled, 0) AS handled, CASE WHEN sbom_id = 'bom-1' THEN 1 ELSE 0 END AS edges FROM d LEFT JOIN (SELECT sbom_id, count(*) AS n, count(*) FILTER (WHERE cpe_source <> '') AS handled FROM i GROUP BY 1) USING (sbom_id)), "
    "raw AS (" + " UNION ALL ".join([ROW.format(*r[:3], "''", "counted", r[3]) for r in DOC] + [ROW.format(*r[:3], "bom_ref", "outside", r[3]) for r in OUT] + [ROW.format(*r[:3], "bom_ref", "numbered", r[3]) for r in ALL]) + "), "
    "named AS (SELECT sbom_id, bom_ref, arg_min(ctype, place) AS ctype, arg_min(lower(regexp_extract(purl, '^pkg:([^/@?#]*)', 1)), place) AS eco FROM i WHERE bom_ref <> '' GROUP BY 1, 2), "
    f"judged AS (SELECT sbom_id, validator, rule_id, bom_ref, {POLICY} AS severity FROM (SELECT raw.*, coalesce(ctype, '') AS ctype, coalesce(eco, '') AS eco FROM raw LEFT JOIN named USING (sbom_id, bom_ref))), found AS (SELECT * FROM judged WHERE severity >= 0)"
)
NAMES = "CASE severity " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in I.SEVERITIES.items()) + " END"
STATUS = "SELECT sbom_id, v AS validator, CASE WHEN v = 'spdx' AND sbom_id = 'bom-2' THEN 'errored' WHEN worst >= 3 THEN 'failed' WHEN worst IS NOT NULL THEN 'passed-with-warnings' ELSE 'passed' END AS status FROM d CROSS JOIN (SELECT unnest(['ntia', 'eu-cra', 'cyclonedx', 'spdx']) AS v) LEFT JOIN (SELECT sbom_id, validator AS v, max(severity) AS worst FROM found GROUP BY 1, 2) USING (sbom_id, v)"


@query(f"{JUDGED} SELECT sbom_id, validator, rule_id, {NAMES} AS severity, bom_ref FROM found")
def compliance_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all validators, their severities by policy and overrides."""
    return found(spark, sf_dir)[2].withColumn("severity", I.severity_name(F.col("severity")))


@query(f"{JUDGED} {STATUS}")
def compliance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by validator; one could not run on one document."""
    documents, _, rows = found(spark, sf_dir)
    errored = documents.filter("sbom_id = 'bom-2'").select("sbom_id", F.lit("spdx").alias("validator"))
    return compliance.statuses(documents, rows, RAN, errored)


@query(f"{JUDGED} SELECT sbom_id, concat('bom:compliance:', k) AS key, v AS value FROM (SELECT sbom_id, concat(validator, ':status') AS k, status AS v FROM ({STATUS.replace(chr(39) + 'spdx' + chr(39) + ' AND sbom_id = ' + chr(39) + 'bom-2' + chr(39), chr(39) + 'none' + chr(39))}) UNION ALL SELECT sbom_id, unnest(['findings-count', 'actionable-findings-count', 'critical-count', 'high-count', 'medium-count', 'low-count', 'info-count']), unnest([n, a, x4, x3, x2, x1, x0])::VARCHAR FROM (SELECT d.sbom_id, count(severity) AS n, count(*) FILTER (WHERE severity >= 2) AS a, count(*) FILTER (WHERE severity = 4) AS x4, count(*) FILTER (WHERE severity = 3) AS x3, count(*) FILTER (WHERE severity = 2) AS x2, count(*) FILTER (WHERE severity = 1) AS x1, count(*) FILTER (WHERE severity = 0) AS x0 FROM d LEFT JOIN found USING (sbom_id) GROUP BY 1))")
def compliance_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compliance stamps on documents."""
    documents, _, rows = found(spark, sf_dir)
    return compliance.stamps(documents, rows, compliance.statuses(documents, rows, RAN)).select("sbom_id", F.explode("props").alias("key", "value"))


@query(f"{JUDGED} SELECT sbom_id, place, concat('bom:compliance:finding:', rule_id) AS key, {NAMES} AS value FROM (SELECT sbom_id, bom_ref, rule_id, arg_max(severity, (validator, severity)) AS severity FROM found WHERE bom_ref <> '' GROUP BY 1, 2, 3) JOIN (SELECT sbom_id, bom_ref, min(place) AS place FROM i GROUP BY 1, 2) USING (sbom_id, bom_ref)")
def compliance_component_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compliance stamps on components, the first of each reference."""
    _, items, rows = found(spark, sf_dir)
    return compliance.component_stamps(rows, items)


@query(f"{JUDGED} SELECT d.sbom_id, count(severity) AS hits, count(severity) > 0 AS failed FROM d LEFT JOIN (SELECT * FROM found WHERE severity >= 4) f USING (sbom_id) GROUP BY 1")
def compliance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a critical finding; some pass."""
    documents, _, rows = found(spark, sf_dir)
    return compliance.gate(documents, rows, " Critical ")


@query("WITH RECURSIVE t AS (SELECT p_partkey AS node, concat('/', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS place FROM part WHERE p_partkey % 4 = 0 AND p_partkey < 40 UNION ALL SELECT p_partkey, concat(place, '/', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) FROM part JOIN t ON node = CASE WHEN p_partkey % 50 = 49 THEN p_partkey WHEN p_partkey < 40 THEN p_partkey - p_partkey % 4 ELSE p_partkey // 3 END WHERE NOT (p_partkey % 4 = 0 AND p_partkey < 40) AND p_partkey % 50 <> 49) SELECT node, place FROM t")
def component_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the tree from parents alone; nodes that are their own parents, and what hangs on them, have none."""
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'b' AS sbom_id", "p_partkey AS node", "CASE WHEN p_partkey % 50 = 49 THEN p_partkey WHEN p_partkey < 40 THEN CASE WHEN p_partkey % 4 > 0 THEN p_partkey - p_partkey % 4 END ELSE p_partkey div 3 END AS parent", "p_partkey AS ord")
    return compliance.placed(nodes).select("node", "place")
