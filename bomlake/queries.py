"""Queries of the domain operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.functions import paths as P
from bomlake.operators import builds, dedup, enrichment, exposition, images, inventory, lifecycles, merging, properties, resolving, sarif, search, untracked, validators
from bomlake.sources import adapters, documents
from bomlake.streaming import metrics as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

C, E, L, FILES, PATHS, M = (adapters.sql(v) for v in ("components", "edges", "layer_entries", "files", "paths", "metrics"))
KEY = "CASE WHEN purl <> '' THEN concat('purl:', lower(CASE WHEN strpos(purl, '?') > 1 THEN left(purl, strpos(purl, '?') - 1) ELSE purl END)) WHEN trim(cpe) <> '' THEN concat('cpe:', lower(trim(cpe))) WHEN sha256 <> '' THEN concat('sha256:', lower(sha256)) WHEN name <> '' AND version <> '' THEN concat('nvt:', lower(ctype), ':', lower(name), ':', lower(version)) ELSE concat('row:', ord) END"
STRENGTH = "(CASE WHEN purl <> '' THEN 100 ELSE 0 END + CASE WHEN cpe <> '' THEN 10 ELSE 0 END + n_locations)"
NOW = "2000-01-01"
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 50.0, 100.0]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def view(spark, sf_dir, name):
    return adapters.view(spark, sf_dir, name)


RANKED = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY {STRENGTH} DESC, ord) AS nth, min(ord) OVER (PARTITION BY key) AS place, count(*) OVER (PARTITION BY key) AS members FROM (SELECT *, {KEY} AS key FROM {C}))"


@query(f"SELECT key, bom_ref, ctype, name, version, place, members, coalesce(suppliers, '') AS suppliers FROM {RANKED} LEFT JOIN (SELECT {KEY} AS k, string_agg(DISTINCT supplier, ',' ORDER BY supplier) FILTER (WHERE supplier <> '') AS suppliers FROM {C} GROUP BY 1) ON k = key WHERE nth = 1")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.deduplicated(view(spark, sf_dir, "components")).select("key", "bom_ref", "ctype", "name", "version", "place", "members", "suppliers")


@query(f"SELECT eco, count(*) AS components, sum(members) AS rows_in, sum(CASE WHEN members > 1 THEN 1 ELSE 0 END) AS merged FROM {RANKED} WHERE nth = 1 GROUP BY 1")
def dedup_by_ecosystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.deduplicated(view(spark, sf_dir, "components")).groupBy("eco").agg(F.count("*").alias("components"), F.sum("members").alias("rows_in"), F.count_if(F.col("members") > 1).alias("merged"))


PARSED = rf"(SELECT *, regexp_replace(regexp_replace(regexp_replace(purl, '^pkg:/*', ''), '#[^#]*$', ''), '\?[^?]*$', '') AS main FROM {C} WHERE purl <> '')"
PARTS = f"(SELECT *, lower(split_part(pth, '/', 1)) AS type, regexp_extract(pth, '^[^/]+/(.+)/[^/]*$', 1) AS namespace, regexp_extract(pth, '/([^/]+)$', 1) AS pname, regexp_extract(main, '^[^@]*@(.*)$', 1) AS pversion FROM (SELECT *, split_part(main, '@', 1) AS pth FROM {PARSED}))"


@query(rf"SELECT bom_ref, type, namespace, pname AS name, pversion AS version, regexp_extract(purl, '\?([^?]*)$', 1) AS qualifiers, type AS eco, split_part(lower(regexp_replace(purl, '[?#].*$', '')), '@', 1) AS coordinates, concat('pkg:', type, '/', CASE WHEN namespace <> '' THEN concat(namespace, '/') ELSE '' END, pname, CASE WHEN pversion <> '' THEN concat('@', pversion) ELSE '' END) AS formatted FROM {PARTS}")
def purl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components").filter("purl <> ''").withColumn("p", I.parse_purl(F.col("purl")))
    return c.select("bom_ref", "p.type", "p.namespace", "p.name", "p.version", "p.qualifiers", I.ecosystem(F.col("purl")).alias("eco"), I.purl_coordinates(F.col("purl")).alias("coordinates"), I.format_purl(F.col("p.type"), F.col("p.namespace"), F.col("p.name"), F.col("p.version")).alias("formatted"))


VENDOR = "CASE WHEN type = 'pypi' THEN concat(pname, '_project') WHEN type = 'maven' AND namespace <> '' THEN split_part(namespace, '.', -1) WHEN type = 'golang' AND namespace <> '' THEN split_part(namespace, '/', -1) ELSE pname END"


def cpe(vendor: str, product: str) -> str:
    return f"concat('cpe:2.3:a:', lower({vendor}), ':', lower({product}), ':', CASE WHEN pversion = '' THEN '*' ELSE pversion END, ':*:*:*:*:*:*:*')"


@query(f"SELECT bom_ref, {cpe(VENDOR, 'pname')} AS cpe, true AS valid FROM {PARTS}")
def cpe_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components").filter("purl <> ''").withColumn("p", I.parse_purl(F.col("purl"))).withColumn("g", I.guess_cpe(F.col("p")))
    c = c.withColumn("cpe", I.build_cpe(F.lit("a"), F.col("g.vendor"), F.col("g.product"), F.col("p.version")))
    return c.select("bom_ref", "cpe", I.cpe_valid(F.col("cpe")).alias("valid"))


DICTIONARY = f"(SELECT DISTINCT eco AS d_type, lower(ns) AS d_ns, lower(name) AS d_name, 'acme' AS d_vendor, lower(name) AS d_product FROM {C})"
CANDIDATES = f"(SELECT bom_ref, cpe, max(confidence) AS confidence, string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM (SELECT bom_ref, {cpe('d_vendor', 'd_product')} AS cpe, CAST(0.95 AS DECIMAL(3,2)) AS confidence, 'dictionary' AS source FROM {PARTS} JOIN {DICTIONARY} ON type = d_type AND lower(namespace) = d_ns AND lower(pname) = d_name UNION ALL SELECT bom_ref, {cpe(VENDOR, 'pname')}, CAST(0.70 AS DECIMAL(3,2)), 'heuristic' FROM {PARTS}) GROUP BY 1, 2)"


@query(f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY bom_ref ORDER BY confidence DESC, source, cpe) = 1 AND confidence >= 0.70 THEN 'primary' WHEN confidence >= 0.50 THEN 'alternative' ELSE 'rejected' END AS status FROM {CANDIDATES}")
def cpe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    dictionary = c.select(F.col("eco").alias("d_type"), F.lower("ns").alias("d_ns"), F.lower("name").alias("d_name"), F.lit("acme").alias("d_vendor"), F.lower("name").alias("d_product")).distinct()
    return inventory.classified(inventory.candidates(c, dictionary))


SCORE = "CASE WHEN w = f THEN {0} WHEN translate(w, '-.', '__') = translate(f, '-.', '__') THEN {1} WHEN w <> '' AND f <> '' AND (contains(f, w) OR contains(w, f)) THEN {2} ELSE 0.00 END"


@query(f"SELECT bom_ref, CAST({SCORE.format('0.50', '0.40', '0.10')} AS DECIMAL(3,2)) AS vendor_score FROM (SELECT bom_ref, lower(supplier) AS w, lower({VENDOR}) AS f FROM {PARTS})")
def cpe_vendor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components").filter("purl <> ''").withColumn("g", I.guess_cpe(I.parse_purl(F.col("purl"))))
    return c.select("bom_ref", search.vendor_share(F.lower("g.vendor"), F.lit(""), F.lower("supplier")).cast("decimal(3,2)").alias("vendor_score"))


LIVE = f"(SELECT path, layer, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY layer DESC, seq DESC, op DESC) AS nth FROM {L}) WHERE nth = 1 AND op = 'add')"


@query(f"SELECT path, layer, seq FROM {LIVE}")
def overlay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.effective(view(spark, sf_dir, "layer_entries"))


@query(f"SELECT layer, count(*) AS files FROM {LIVE} GROUP BY 1")
def overlay_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.effective(view(spark, sf_dir, "layer_entries")).groupBy("layer").agg(F.count("*").alias("files"))


PLACES = f"(SELECT bom_ref, unnest([0, 1]) AS pos, unnest([concat('opt/app', (ord + 1) % 20, '/f', ord + 1), concat('opt/app', ord % 20, '/f', ord)]) AS path FROM {C})"


@query(f"SELECT c.bom_ref, m.layer, m.path, CASE WHEN m.path IS NULL THEN 'none' ELSE 'medium' END AS confidence FROM {C} c LEFT JOIN (SELECT bom_ref, layer, path FROM (SELECT bom_ref, l.layer, path, row_number() OVER (PARTITION BY bom_ref ORDER BY pos) AS nth FROM {PLACES} JOIN {LIVE} l USING (path)) WHERE nth = 1) m USING (bom_ref)")
def layer_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda n: F.concat(F.lit("opt/app"), (F.col("ord") + n) % 20, F.lit("/f"), F.col("ord") + n)
    c = view(spark, sf_dir, "components").withColumn("locations", F.array(place(1), place(0)))
    return images.attributed(c, images.effective(view(spark, sf_dir, "layer_entries")))


TARGET = f"(SELECT path, arg_max(h, ord) AS h FROM {FILES} WHERE img = 'target' GROUP BY 1)"
BASE = f"(SELECT * FROM {FILES} WHERE img = 'base')"


@query(f"SELECT t.path, CASE WHEN b.p IS NOT NULL OR k.path IS NOT NULL THEN 'base' ELSE 'app' END AS origin, CASE WHEN b.p IS NOT NULL THEN 'same' WHEN k.path IS NOT NULL THEN 'modified' ELSE '' END AS state, coalesce(b.p, '') AS base_path FROM {TARGET} t LEFT JOIN (SELECT h, arg_min(path, ord) AS p FROM {BASE} GROUP BY 1) b USING (h) LEFT JOIN (SELECT DISTINCT path FROM {BASE}) k ON k.path = t.path")
def base_content_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    return images.content_diff(files.filter("img = 'target'"), files.filter("img = 'base'"))


@query(f"SELECT path, count(*) AS n FROM {FILES} WHERE img = 'target' AND path IN (SELECT path FROM {BASE}) GROUP BY 1")
def base_path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    return files.filter("img = 'target'").join(files.filter("img = 'base'").select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("n"))


LAYERS = f"(SELECT layer AS idx, md5(concat('layer', layer, ':', count(*))) AS digest FROM {L} GROUP BY layer)"


#: Bases against the whole image: its first layers, these with one changed, more layers than it has, none.
BASES = f"(SELECT 'same' AS base, idx, digest FROM {LAYERS} WHERE idx < 4 UNION ALL SELECT 'changed', idx, CASE WHEN idx = 2 THEN 'x' ELSE digest END FROM {LAYERS} WHERE idx < 4 UNION ALL SELECT 'longer', idx, digest FROM {LAYERS} UNION ALL SELECT 'longer', 99, 'y')"


@query(f"SELECT base, count(*) FILTER (WHERE l.digest IS NULL OR l.digest <> b.digest) = 0 AS is_prefix, count(*) AS base_layers FROM {BASES} b LEFT JOIN {LAYERS} l USING (idx) GROUP BY 1 UNION ALL SELECT 'empty', false, 0")
def base_layer_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = view(spark, sf_dir, "layer_entries").groupBy(F.col("layer").alias("idx")).agg(F.count("*").alias("n")).select(F.col("idx").cast("int").alias("idx"), F.md5(F.concat(F.lit("layer"), "idx", F.lit(":"), "n")).alias("digest"))
    first = layers.filter("idx < 4")
    changed = first.withColumn("digest", F.when(F.col("idx") == 2, "x").otherwise(F.col("digest")))
    bases = {"same": first, "changed": changed, "longer": layers.unionByName(spark.range(1).selectExpr("99 AS idx", "'y' AS digest")), "empty": first.filter("false")}
    return reduce(DataFrame.unionByName, [images.layer_prefix(layers, b).select(F.lit(name).alias("base"), "is_prefix", "base_layers") for name, b in bases.items()])


def rules_sql(path: str) -> str:
    exact = [r for r in images.RULES if r[2] == "exact"]
    affix = lambda k: sorted((r for r in images.RULES if r[2] == k), key=lambda r: -len(r[3]))
    tests = [*[(f"regexp_extract({path}, '([^/]*)$', 1) = '{v}'", n, a) for n, a, _, v in exact], *[(f"starts_with({path}, '{v}')", n, a) for n, a, _, v in affix("prefix")], *[(f"ends_with({path}, '{v}')", n, a) for n, a, _, v in affix("suffix")], *[(f"regexp_matches({path}, '{images.glob_pattern(v) if k == 'glob' else v}')", n, a) for kind in ("glob", "regex") for n, a, k, v in images.RULES if k == kind]]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {t[0]} THEN '{t[i]}'" for t in tests) + f" ELSE '{other}' END"
    return f"(SELECT *, {case(1, '')} AS rule, {case(2, 'keep')} AS action FROM {PATHS})"


@query(f"SELECT ord, path, rule, action FROM {rules_sql('path')}")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.classified(view(spark, sf_dir, "paths"))


DOCS = f"(regexp_extract(path, '([^/]*)$', 1) IN {images.DOC_NAMES} OR lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN {images.DOC_SUFFIXES})"


@query(f"SELECT action, {DOCS} AS documentation, count(*) AS n FROM {rules_sql('path')} WHERE action NOT IN ('skip', 'redundant_under_archive') GROUP BY 1, 2")
def noise_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = images.classified(view(spark, sf_dir, "paths")).filter(~F.col("action").isin("skip", "redundant_under_archive"))
    return kept.groupBy("action", images.documentation(F.col("path")).alias("documentation")).agg(F.count("*").alias("n"))


DIRS = f"(SELECT dir, count(*) AS n_files, sum(size) AS bytes, count(DISTINCT child) AS children FROM (SELECT size, array_to_string(p[1:n], '/') AS dir, p[n + 1] AS child FROM (SELECT size, p, unnest(range(1, len(p))) AS n FROM (SELECT size, string_split(path, '/') AS p FROM {FILES}))) GROUP BY 1)"


@query(f"SELECT dir, n_files, bytes, children FROM {DIRS}")
def directory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.directories(view(spark, sf_dir, "files")).select("dir", "n_files", "bytes", "children")


TREES = adapters.sql("trees")
SEEN = f"(SELECT dir, count(*) AS n_files, count(DISTINCT child) AS children, list(DISTINCT child) AS names, list(DISTINCT lower(child)) AS low FROM (SELECT array_to_string(p[1:n], '/') AS dir, p[n + 1] AS child FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM {TREES}))) GROUP BY 1)"
POINTS = "CASE WHEN list_has_any(names, ['Makefile', 'makefile', 'GNUmakefile']) AND list_has_any(names, ['configure', 'configure.ac', 'configure.in']) THEN 5 ELSE 0 END + CASE WHEN list_contains(names, 'CMakeLists.txt') THEN 4 ELSE 0 END + CASE WHEN version <> '' THEN 5 ELSE 0 END + CASE WHEN list_contains(low, 'src') AND list_contains(low, 'include') THEN 3 ELSE 0 END + CASE WHEN list_has_any(low, ['test', 'tests', 'spec']) THEN 2 ELSE 0 END + CASE WHEN len(list_filter(low, lambda x: starts_with(x, 'license') OR starts_with(x, 'licence') OR x IN ('copying', 'copying.lib'))) > 0 AND len(list_filter(low, lambda x: starts_with(x, 'readme'))) > 0 THEN 2 ELSE 0 END + CASE WHEN n_files > 1000 THEN 3 WHEN n_files > 100 THEN 1 ELSE 0 END"
VERSION = "coalesce(" + ", ".join(f"nullif(regexp_extract(split_part(dir, '/', -1), '{f}', 2), '')" for f in (r"^([A-Za-z][A-Za-z0-9_+.-]*?)-version-(\d[A-Za-z0-9._+-]*)$", r"^([A-Za-z][A-Za-z0-9_+.-]*?)-v(\d[A-Za-z0-9._+-]*)$", r"^([A-Za-z][A-Za-z0-9+.-]*?)_(\d[A-Za-z0-9._+-]*)$", r"^([A-Za-z][A-Za-z0-9_+.-]*?)-(\d[A-Za-z0-9._+-]*)$")) + ", '')"
SCORED = f"(SELECT dir, n_files, children, version, {POINTS} AS score FROM (SELECT *, {VERSION} AS version FROM {SEEN}))"


@query(f"SELECT dir, n_files, children, version, score FROM {SCORED}")
def density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.density(images.directories(view(spark, sf_dir, "trees"))).select("dir", "n_files", "children", "version", "score")


@query(f"SELECT split_part(dir, '/', 1) AS top, arg_min(dir, dir) AS dir, arg_min(score, dir) AS score, arg_min(n_files, dir) AS n_files FROM {SCORED} WHERE children >= 3 AND score >= 7 GROUP BY 1")
def dense_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.dense(images.directories(view(spark, sf_dir, "trees")))


@query(f"SELECT path, arg_max(dir, length(dir)) AS root FROM (SELECT DISTINCT path FROM {FILES}) JOIN {DIRS} ON starts_with(path, concat(dir, '/')) WHERE children >= 3 GROUP BY 1")
def cluster_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    roots = images.directories(files).filter("children >= 3").select(F.col("dir").alias("root"))
    return images.contained(files.select("path").distinct(), roots)


@query(f"SELECT f.path, f.h, m.match FROM {FILES} f JOIN (SELECT h, arg_min(concat('file-', ord), ord) AS match FROM {FILES} GROUP BY 1) m USING (h)")
def fingerprint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files")
    known = files.select("h", "ord", F.concat(F.lit("file-"), "ord").alias("name"))
    return images.lookup(files.select("path", "h"), known)


CYCLES = "(SELECT c_mktsegment AS product, CAST(year(o_orderdate) AS VARCHAR) AS cyc, min(o_orderkey) AS pos, CAST(date_trunc('year', min(o_orderdate)) AS DATE) AS rel FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
USERS = "(SELECT concat('cust-', c_custkey) AS bom_ref, c_mktsegment AS product, concat('v', 1992 + c_custkey % 8, '.', c_custkey % 3) AS version, 'major' AS form FROM customer)"


@query(f"SELECT bom_ref, product, cyc, CASE WHEN rel + INTERVAL 3 YEAR <= DATE '{NOW}' THEN 'eol' WHEN rel + INTERVAL 18 MONTH <= DATE '{NOW}' THEN 'maintenance' WHEN rel IS NOT NULL THEN 'active' ELSE 'unknown' END AS status, datesub('day', TIMESTAMP '{NOW}', CAST(rel + INTERVAL 3 YEAR AS TIMESTAMP)) AS days_until_eol FROM (SELECT *, split_part(regexp_replace(version, '^v', ''), '.', 1) AS cyc FROM {USERS}) JOIN {CYCLES} USING (product, cyc)")
def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cycles = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("product"), F.year("o_orderdate").cast("string").alias("cyc")).agg(F.min("o_orderkey").alias("pos"), F.trunc(F.min("o_orderdate"), "year").alias("rel"))
    cycles = cycles.withColumns({"support": F.add_months("rel", 18), "eol": F.add_months("rel", 36)})
    users = read("customer").selectExpr("concat('cust-', c_custkey) AS bom_ref", "c_mktsegment AS product", "concat('v', 1992 + c_custkey % 8, '.', c_custkey % 3) AS version", "'major' AS form")
    return enrichment.matched_cycles(users, cycles, F.lit(NOW).cast("date"))


META = f"(SELECT lower(CASE WHEN strpos(purl, '?') > 1 THEN left(purl, strpos(purl, '?') - 1) ELSE purl END) AS purl_key, concat('meta ', name) AS supplier, 'MIT' AS licence, ord FROM {C} WHERE purl <> '')"


@query(f"SELECT bom_ref, CASE WHEN c.supplier <> '' THEN c.supplier ELSE coalesce(m.s, '') END AS supplier, coalesce(m.l, '') AS licence, c.supplier = '' AND coalesce(m.s, '') <> '' AS filled FROM {C} c LEFT JOIN (SELECT purl_key, arg_min(supplier, ord) AS s, arg_min(licence, ord) AS l FROM {META} GROUP BY 1) m ON c.purl <> '' AND lower(CASE WHEN strpos(c.purl, '?') > 1 THEN left(c.purl, strpos(c.purl, '?') - 1) ELSE c.purl END) = purl_key")
def registry_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    meta = c.filter("purl <> ''").select(I.purl_key(F.col("purl")).alias("purl_key"), F.concat(F.lit("meta "), "name").alias("supplier"), F.lit("MIT").alias("licence"), "ord")
    return enrichment.filled(c, meta)


def policy_sql() -> str:
    """The last fitting rule first."""
    tests = [" AND ".join(f"{c} = '{v}'" for c, v in (("rule_id", r), ("ctype", t), ("eco", e)) if v) + f" THEN {s}" for r, t, e, s in reversed(inventory.POLICY)]
    return "CASE " + " ".join(f"WHEN {t}" for t in tests) + " ELSE raw END"


TESTS = {"NTIA-NAME": "name = ''", "NTIA-VERSION": "version = ''", "NTIA-SUPPLIER": "supplier = ''", "NTIA-IDENTIFIER": "purl = '' AND cpe = ''"}
FINDINGS = "(" + " UNION ALL ".join(f"SELECT bom_ref, ctype, lower(regexp_extract(purl, '^pkg:([^/@?#]*)', 1)) AS eco, '{r}' AS rule_id, {s} AS raw FROM {C} WHERE ctype <> 'file' AND {TESTS[r]}" for r, s in inventory.COMPONENT_RULES.items()) + ")"
JUDGED = f"(SELECT *, {policy_sql()} AS severity FROM {FINDINGS})"
NAMES = "CASE severity " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in I.SEVERITIES.items()) + " ELSE 'unknown' END"


def judged(spark, sf_dir):
    return inventory.with_policy(inventory.findings(view(spark, sf_dir, "components")))


@query(f"SELECT bom_ref, rule_id, {NAMES} AS severity FROM {JUDGED}")
def compliance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("bom_ref", "rule_id", I.severity_name(F.col("severity")).alias("severity"))


@query(f"SELECT rule_id, count(*) AS n, sum(CASE WHEN severity >= 2 THEN 1 ELSE 0 END) AS actionable, max(severity) AS worst FROM {JUDGED} GROUP BY 1")
def compliance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.rollup(judged(spark, sf_dir))


@query(f"SELECT count(*) > 0 AS failed FROM {JUDGED} WHERE severity >= 3")
def compliance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).filter("severity >= 3").limit(1).agg((F.count("*") > 0).alias("failed"))


@query(f"SELECT dst, count(*) - 1 AS repeats FROM {E} GROUP BY 1 HAVING count(*) > 1")
def repeated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.repeated_refs(view(spark, sf_dir, "edges"))


@query(f"SELECT src, min(ord) AS first, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS targets FROM (SELECT src, dst, min(ord) AS ord FROM {E} WHERE rel NOT IN ('contains', 'unknown') GROUP BY 1, 2) GROUP BY 1")
def edges_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.grouped_edges(view(spark, sf_dir, "edges"))


@query(f"SELECT src, dst, rel FROM {E} WHERE dst NOT IN (SELECT bom_ref FROM {C} WHERE ctype = 'file')")
def edge_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.pruned_edges(view(spark, sf_dir, "edges"), view(spark, sf_dir, "components").filter("ctype = 'file'")).select("src", "dst", "rel")


@query(f"SELECT dst AS key, arg_min(src, ord) AS embedded_in, count(DISTINCT src) AS edges FROM {E} WHERE rel = 'contains' GROUP BY 1")
def subcomponent_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = view(spark, sf_dir, "edges").filter("rel = 'contains'").select(F.col("src").alias("parent"), F.col("dst").alias("key"), "ord")
    return inventory.lifted(nested)


DAG = "(SELECT DISTINCT p_partkey AS name, p_partkey // 3 AS dep FROM part WHERE p_partkey > 2)"


@query(f"WITH RECURSIVE r AS (SELECT p_partkey AS name, 0 AS level FROM part WHERE p_partkey IN (1, 2) UNION ALL SELECT d.name, level + 1 FROM {DAG} d JOIN r ON d.dep = r.name) SELECT name, level FROM r")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dag = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 2").selectExpr("p_partkey AS name", "p_partkey div 3 AS dep").distinct()
    return inventory.levels(dag).select("name", "level")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE purl <> '') AS with_purl, count(*) FILTER (WHERE ctype = 'file') AS files, CAST(round(100.0 * count(*) FILTER (WHERE purl <> '') / count(*), 2) AS DECIMAL(5,2)) AS percent FROM {C}")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    share = F.round(F.lit(100).cast("decimal(10,1)") * F.count_if(F.col("purl") != "") / F.count("*"), 2).cast("decimal(5,2)")
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("purl") != "").alias("with_purl"), F.count_if(F.col("ctype") == "file").alias("files"), share.alias("percent"))


#: Components as enrichment leaves them.
STAMPED = f"(SELECT *, CASE WHEN ord % 9 = 0 THEN 'unknown' ELSE 'app' END AS origin, CASE WHEN ord % 13 = 0 THEN 'untracked-scan' ELSE 'package' END AS method, CASE WHEN ord % 14 = 0 THEN 'binary' ELSE '' END AS category, CASE ord % 5 WHEN 0 THEN 'low' WHEN 1 THEN '0.65' WHEN 2 THEN '0.70' WHEN 3 THEN 'odd' ELSE '' END AS confidence FROM {C})"
LABELLED = f"(SELECT *, concat(chr(34), CASE WHEN name <> '' AND version <> '' THEN concat(name, '@', version) WHEN name <> '' THEN name WHEN purl <> '' THEN purl ELSE bom_ref END, chr(34)) AS own, CASE WHEN ord % 4 > 0 THEN concat('opt/', name) ELSE bom_ref END AS locations FROM {STAMPED})"


@query(f"SELECT bom_ref, '001' AS rule, 'warning' AS level, concat('Untracked ', CASE WHEN category <> '' THEN category ELSE 'component' END, ' ', own, CASE WHEN ord % 4 > 0 THEN concat(' found at /opt/', name) ELSE '' END, '.') AS message, locations FROM {LABELLED} WHERE method = 'untracked-scan' OR category <> '' UNION ALL SELECT bom_ref, '002', 'note', concat('Component ', own, ' has Origin=unknown.'), locations FROM {LABELLED} WHERE origin = 'unknown' UNION ALL SELECT bom_ref, '003', 'note', concat('Component ', own, ' (PURL ', chr(34), purl, chr(34), ') has no CPE.'), locations FROM {LABELLED} WHERE purl <> '' AND cpe = '' UNION ALL SELECT bom_ref, '004', 'note', concat('Component ', own, ' has a low-confidence CPE (heuristic).'), locations FROM {LABELLED} WHERE confidence IN ('low', '0.65')")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components").selectExpr("*", *[x.strip() for x in re.findall(r"CASE .*? END AS \w+", STAMPED.split(" FROM ")[0])])
    return sarif.results(c.withColumn("places", F.when(F.col("n_locations") > 0, F.array(F.concat(F.lit("/opt/"), "name"))))).select("bom_ref", "rule", "level", "message", "locations")


LE = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{i}" for i, b in enumerate(BOUNDS))


@query(f"SELECT label, count(*) AS n, round(sum(CASE WHEN value > 0 THEN value ELSE 0 END), 4) AS counter, arg_max(value, (ts, ord)) AS gauge, {LE} FROM {M} GROUP BY 1")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.buckets(view(spark, sf_dir, "metrics"), BOUNDS).withColumn("counter", F.round("counter", 4))


LICENCE_LINE = r"(?i)licen[sc]ed? under the [^\n]*"


LICENCE_CASES = [("mit", "MIT"), ("apache.*2", "Apache-2.0"), ("lgpl.*3|lesser general public.*3", "LGPL-3.0"), ("agpl|affero", "AGPL-3.0"), ("gpl.*3|general public.*3", "GPL-3.0"), ("gpl.*2|general public.*2", "GPL-2.0"), ("bsd.*3|3-clause", "BSD-3-Clause"), ("bsd.*2|2-clause", "BSD-2-Clause"), ("mozilla.*2|mpl", "MPL-2.0")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(line), '\\b({p})') THEN '{n}'" for p, n in LICENCE_CASES) + f" ELSE line END AS licence FROM (SELECT doc_id, regexp_extract(text, '{LICENCE_LINE}', 0) AS line FROM documents) WHERE line <> ''")
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_extract("text", LICENCE_LINE, 0).alias("line")).filter("line <> ''")
    return d.select("doc_id", I.licence_name(F.col("line")).alias("licence"))


@query("SELECT concat('part-', p_partkey) AS bom_ref, CASE p_partkey % 5 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha3-512' WHEN 3 THEN 'md5' ELSE 'blake2b-256' END AS algorithm FROM part")
def hash_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, [" SHA-256", "sha_1", "SHA3_512", "MD5 ", "BLAKE2b-256"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part-"), "p_partkey").alias("bom_ref"), I.hash_algorithm(raw).alias("algorithm"))


@query(f"SELECT ord, regexp_replace(path, '^/', '') AS normal, regexp_extract(regexp_replace(path, '^/', ''), '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix FROM (SELECT ord, regexp_replace(path, '/$', '') AS path FROM {PATHS})")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "paths").select("ord", P.normalised(F.concat(F.lit("./x/../."), "path")).alias("normal"))
    return p.select("ord", "normal", P.parent(F.col("normal")).alias("parent"), P.basename(F.col("normal")).alias("base"), P.extension(F.col("normal")).alias("suffix"))


def pair(name: str, value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN concat(',\"{name}\":', to_json({value})) ELSE '' END"


@query(f"SELECT ord, concat('{{\"type\":\"', ctype, '\",\"bom-ref\":\"', bom_ref, '\"', {pair('name', 'name')}, {pair('version', 'version')}, {pair('purl', 'purl')}, CASE WHEN supplier <> '' THEN concat(',\"supplier\":{{\"name\":', to_json(supplier), '}}') ELSE '' END, '}}') AS json FROM {C}")
def cyclonedx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.cyclonedx_lines(view(spark, sf_dir, "components"))


@query(f"SELECT ord, concat('{{\"SPDXID\":\"SPDXRef-', bom_ref, '\",\"name\":', to_json(name), {pair('versionInfo', 'version')}, ',\"downloadLocation\":\"NOASSERTION\"', CASE WHEN purl <> '' THEN concat(',\"externalRefs\":[{{\"referenceCategory\":\"PACKAGE-MANAGER\",\"referenceType\":\"purl\",\"referenceLocator\":', to_json(purl), '}}]') ELSE '' END, '}}') AS json FROM {C}")
def spdx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.spdx_lines(view(spark, sf_dir, "components"))


#: Images made of orders: an order's lines are its history, those not returned its layers.
HISTORY = "(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS idx, CASE l_partkey % 9 WHEN 0 THEN '/bin/sh -c #(nop) COPY file:x in /app' WHEN 1 THEN 'RUN /bin/sh -c make' WHEN 2 THEN '/bin/sh -c apt-get update' WHEN 3 THEN 'env A=1' WHEN 4 THEN 'buildah: COPY a b' WHEN 5 THEN 'containers-storage: ADD x y' WHEN 6 THEN 'jib-classes' WHEN 7 THEN '' ELSE 'RUNTIME x' END AS created_by, l_returnflag = 'R' AS empty_layer FROM lineitem WHERE l_orderkey % 3 <> 0)"
IMAGE = "concat('image-', o_orderkey)"
AUTHOR = "CASE WHEN o_orderkey % 11 = 1 THEN 'Kaniko' ELSE '' END"
LABEL = "CASE o_orderkey % 7 WHEN 1 THEN 'moby.buildkit.x' WHEN 2 THEN 'jib.image.y' WHEN 4 THEN 'dev.ko.build' ELSE 'other' END"


def built_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.createOrReplaceTempView("bomlake_lines")
    h = spark.sql(f"SELECT * FROM {HISTORY.replace('FROM lineitem', 'FROM bomlake_lines')}")
    entry = F.struct("idx", F.struct("created_by", F.lit("").alias("author"), F.lit("").alias("comment"), "empty_layer").alias("h"))
    # an order has a few lines, as an image has a few instructions
    h = h.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["h"]).alias("history"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("empty_layer"), F.col("idx")))), lambda i: F.concat(F.lit("sha256:"), i)).alias("layers"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(IMAGE).alias("image"), F.expr(AUTHOR).alias("author"), F.expr(f"map({LABEL}, 'v')").alias("labels"), F.expr("cast(map() as map<string,string>)").alias("annotations"), F.expr("array('/ko-app/x')").alias("entrypoint"))
    return orders.join(h, "o_orderkey", "left")


SIGNED = f"(SELECT o_orderkey, {IMAGE} AS image, {AUTHOR} AS author, {LABEL} AS label, coalesce(n_history, 0) AS n_history, coalesce(n_layers, 0) AS n_layers, coalesce(n_jib, 0) AS n_jib, first_sign FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_history, count(*) FILTER (WHERE NOT empty_layer) AS n_layers, count(*) FILTER (WHERE created_by = 'jib-classes') AS n_jib, arg_min(CASE WHEN starts_with(created_by, 'buildah:') THEN 'buildah' ELSE 'podman' END, idx) FILTER (WHERE starts_with(created_by, 'buildah:') OR starts_with(created_by, 'containers-storage:')) AS first_sign FROM {HISTORY} GROUP BY 1) ON l_orderkey = o_orderkey)"
RUNTIMES = f"(SELECT o_orderkey, image, CASE WHEN label LIKE 'moby%' THEN 'buildkit' WHEN author = 'Kaniko' OR (n_history >= 5 AND n_layers <= 2) THEN 'kaniko' WHEN label LIKE 'jib%' OR n_jib >= 2 THEN 'jib' WHEN label = 'dev.ko.build' THEN 'ko' WHEN first_sign IS NOT NULL THEN first_sign ELSE 'docker' END AS runtime FROM {SIGNED})"
STRIPPED = "CASE WHEN runtime IN ('podman', 'buildah') THEN trim(regexp_replace(created_by, '^(containers-storage:|buildah:)', '')) ELSE created_by END"
WORD = "CASE WHEN {0} LIKE '%#(nop) COPY%' OR {0} LIKE 'COPY %' THEN 'COPY' WHEN {0} LIKE 'ADD %' THEN 'ADD' WHEN {0} LIKE 'env %' THEN 'ENV' WHEN {0} LIKE 'RUN %' OR {0} LIKE '/bin/sh -c%' THEN 'RUN' ELSE 'UNKNOWN' END"
ALIGNED = f"(SELECT image, runtime, layer, created_by, {WORD.format('created_by')} AS instruction FROM (SELECT image, runtime, row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) - 1 AS layer, {STRIPPED} AS created_by FROM {HISTORY} JOIN {RUNTIMES} ON l_orderkey = o_orderkey WHERE NOT empty_layer))"


@query(f"SELECT image, runtime FROM {RUNTIMES}")
def build_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.detected(built_images(spark, sf_dir)).select("image", "runtime")


@query(f"SELECT image, runtime, layer, created_by, instruction FROM {ALIGNED}")
def layer_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.aligned(builds.detected(built_images(spark, sf_dir))).drop("digest")


@query(f"SELECT image, CASE WHEN o_orderkey % 13 = 0 THEN 'high' WHEN n IS NULL THEN 'none' WHEN runtime = 'kaniko' THEN 'low' WHEN whole THEN 'medium' ELSE 'low' END AS confidence FROM {RUNTIMES} LEFT JOIN (SELECT image, count(*) AS n, bool_and(created_by <> '') AS whole FROM {ALIGNED} GROUP BY 1) USING (image)")
def attribution_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    images_ = builds.detected(built_images(spark, sf_dir))
    return builds.trust(images_, builds.aligned(images_), images_.filter("o_orderkey % 13 = 0"))


#: Documents made of suppliers; the first seven hold the components, the others are empty.
BOMS = "(SELECT concat('bom-', s_suppkey) AS sbom_id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END AS author, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2000-01-01' END AS created FROM supplier)"
HELD = f"(SELECT concat('bom-', ord % 7 + 1) AS sbom_id, ord, CASE WHEN ord % 50 = 0 THEN 'part-7' ELSE bom_ref END AS bom_ref, CASE WHEN ord % 23 = 0 THEN 'odd' ELSE ctype END AS ctype, CASE WHEN ord % 29 = 0 THEN '' ELSE name END AS name, purl, CASE WHEN ord % 4 = 0 THEN 0 ELSE 1 END AS n_licences, CASE WHEN ord % 7 = 2 AND ord % 5 = 0 THEN 'nvd-api' ELSE '' END AS cpe_source, '' AS disclosure, concat('/', ord) AS place FROM {C})"
COUNTED = f"(SELECT d.*, coalesce(n, 0) AS n, coalesce(handled, 0) AS handled, CASE WHEN sbom_id = 'bom-1' THEN 1 ELSE 0 END AS edges FROM {BOMS} d LEFT JOIN (SELECT sbom_id, count(*) AS n, count(*) FILTER (WHERE cpe_source <> '') AS handled FROM {HELD} GROUP BY 1) USING (sbom_id))"
ROWS = "SELECT sbom_id, '{0}' AS validator, '{1}' AS rule_id, {2} AS severity, {3} AS bom_ref FROM {4} WHERE {5}"
DOC_TESTS = [("ntia", "NTIA-METADATA-AUTHOR", 3, "author = ''"), ("ntia", "NTIA-METADATA-TIMESTAMP", 3, "created = ''"), ("ntia", "NTIA-RELATIONSHIPS", 2, "n >= 10 AND edges = 0"), ("eu-cra", "EU-CRA-ART13-VULN-HANDLING", 2, "handled = 0"), ("cyclonedx", "CDX-EMPTY-COMPONENTS", 3, "n = 0"), ("spdx", "SPDX-EMPTY-PACKAGES", 3, "n = 0")]
ROW_TESTS = [("eu-cra", "EU-CRA-ART13-LICENSE", 1, "ctype IN ('framework', 'application') AND regexp_matches(purl, '^pkg:(maven|helm|pypi|npm)/') AND n_licences = 0"), ("cyclonedx", "CDX-COMPONENT-NAME-MISSING", 4, "name = ''"), ("cyclonedx", "CDX-COMPONENT-TYPE-INVALID", 3, "ctype = 'odd'"), ("cyclonedx", "CDX-BOMREF-DUPLICATE", 3, "nth > 1"), ("spdx", "SPDX-PACKAGE-NAME-MISSING", 4, "name = ''"), ("spdx", "SPDX-DOWNLOAD-LOCATION-NOASSERTION", 1, "purl = ''"), ("spdx", "SPDX-LICENSE-NOASSERTION", 1, "n_licences = 0")]
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY sbom_id, bom_ref ORDER BY ord) AS nth FROM {HELD})"


@query(" UNION ALL ".join([ROWS.format(v, r, s, "''", COUNTED, t) for v, r, s, t in DOC_TESTS] + [ROWS.format(v, r, s, "bom_ref", NUMBERED, t) for v, r, s, t in ROW_TESTS]))
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("bomlake_suppliers")
    view(spark, sf_dir, "components").createOrReplaceTempView("bomlake_components")
    held = spark.sql(f"SELECT * FROM {HELD.replace(C, 'bomlake_components')}")
    boms = spark.sql(f"SELECT * FROM {BOMS.replace('FROM supplier', 'FROM bomlake_suppliers')}")
    counted = validators.totals(boms, held, boms.filter("sbom_id = 'bom-1'").select("sbom_id"))
    return validators.ntia_documents(counted).unionByName(validators.eu_cra(counted, held)).unionByName(validators.cyclonedx(counted, held)).unionByName(validators.spdx(counted, held))


#: The primary first, then the others in their order.
MEMBERS = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY nth > 1, ord) AS rank FROM (SELECT *, ord % 5 AS layer, row_number() OVER (PARTITION BY key ORDER BY {STRENGTH} DESC, ord) AS nth FROM (SELECT *, {KEY} AS key FROM {C})))"
VALUES = f"(SELECT key, rank, 'supplier' AS name, supplier AS value FROM {MEMBERS} UNION ALL SELECT key, rank, 'type', ctype FROM {MEMBERS})"
KEPT = f"(SELECT key, name, arg_min(value, rank) AS kept FROM {VALUES} GROUP BY 1, 2)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    return dedup.ranked(c).select("key", "rank", (F.col("ord") % 5).alias("layer"), F.create_map(F.lit("supplier"), "supplier", F.lit("type"), "ctype").alias("props"), F.split("name", "-").alias("words"))


@query(f"SELECT key, name, kept AS value FROM {KEPT} UNION ALL SELECT key, concat('conflict:', name), arg_max(value, rank) FROM {VALUES} JOIN {KEPT} USING (key, name) WHERE value <> kept GROUP BY key, name")
def merged_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.properties(members(spark, sf_dir))


@query(f"SELECT key, own AS layer, arg_max(layer, rank) FILTER (WHERE layer <> own) AS also_in_layer, count(*) - 1 AS merged FROM {MEMBERS} JOIN (SELECT key, arg_min(layer, rank) AS own FROM {MEMBERS} GROUP BY 1) USING (key) GROUP BY 1, 2")
def merged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.other_layer(members(spark, sf_dir))


@query(f"SELECT key, item, ord, pos FROM (SELECT *, row_number() OVER (PARTITION BY key, lower(item) ORDER BY rank, pos) AS first FROM (SELECT key, rank, ord, unnest(words) AS item, unnest(range(len(words))) AS pos FROM (SELECT key, rank, ord, string_split(name, '-') AS words FROM {MEMBERS})) WHERE item <> '') WHERE first = 1")
def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.union(members(spark, sf_dir), "words", F.lower("item")).select("key", "item", "rank.ord", "pos")


@query("SELECT label, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM (SELECT label, [" + ", ".join([f"concat('v_bucket{{label=\"', label, '\",le=\"{b:g}\"}} ', count(*) FILTER (WHERE value <= {b}))" for b in BOUNDS] + ["concat('v_bucket{label=\"', label, '\",le=\"+Inf\"} ', count(*))", "concat('v_sum{label=\"', label, '\"} ', CAST(sum(CAST(floor(value) AS BIGINT)) AS VARCHAR))", "concat('v_count{label=\"', label, '\"} ', count(*))"]) + f"] AS lines FROM {M} GROUP BY 1)")
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "metrics")
    whole = m.groupBy("label").agg(F.sum(F.floor("value")).cast("double").alias("total"))
    return exposition.histogram(images.buckets(m, BOUNDS).join(whole, "label"), "v", "label", BOUNDS)


SEARCHED = f"(SELECT DISTINCT {cpe('d_vendor', 'd_product')} AS cpe, lower(d_vendor) AS vendor, lower(d_product) AS product, CASE WHEN pversion = '' THEN '*' ELSE pversion END AS rel FROM (SELECT CASE WHEN ord % 2 = 0 THEN ns ELSE name END AS d_vendor, name AS d_product, version AS pversion FROM {C} WHERE ns <> '' AND ns NOT LIKE '%/%'))"
WORDS = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> '')"
TOTAL = "CAST(least(CASE WHEN vendor = ns OR vendor = nm THEN 0.50 WHEN translate(vendor, '-.', '__') = translate(ns, '-.', '__') OR translate(vendor, '-.', '__') = translate(nm, '-.', '__') THEN 0.40 WHEN ns <> '' AND (contains(vendor, ns) OR contains(ns, vendor)) OR contains(vendor, nm) OR contains(nm, vendor) THEN 0.10 ELSE 0.00 END + CASE WHEN product = nm THEN 0.40 WHEN translate(product, '-.', '__') = translate(nm, '-.', '__') THEN 0.30 WHEN ns <> '' AND product = regexp_extract(ns, '([^/.]*)$', 1) THEN 0.20 WHEN contains(product, nm) OR contains(nm, product) THEN 0.10 ELSE 0.00 END + CASE WHEN pversion = '' THEN 0.05 WHEN rel = pversion THEN 0.20 WHEN rel = '*' THEN 0.10 ELSE 0.00 END, 1.00) AS DECIMAL(3,2))"


@query(f"SELECT bom_ref, cpe, score, CASE WHEN score < 0.30 THEN 'weak' ELSE '' END AS rejected FROM (SELECT bom_ref, cpe, {TOTAL} AS score FROM (SELECT bom_ref, lower(namespace) AS ns, lower(pname) AS nm, pversion FROM {PARTS}) c JOIN {SEARCHED} n ON len(list_filter({WORDS.format('nm')}, lambda w: NOT list_contains({WORDS.format('concat(vendor, chr(95), product)')}, w))) = 0 WHERE pversion = '' OR rel = '*' OR rel = pversion)")
def cpe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    some = c.filter("ns <> '' and ns not like '%/%'")
    names = some.select(I.build_cpe(F.lit("a"), F.when(F.col("ord") % 2 == 0, F.col("ns")).otherwise(F.col("name")), F.col("name"), F.col("version")).alias("cpe"))
    return search.searched(c, names)


CONTENTS = adapters.sql("contents")
KINDS = rf"CASE WHEN regexp_matches(path, '^/?(usr/share/(man|doc|info|locale|i18n|zoneinfo|help)|usr/lib/locale|var/(cache|log|lib/dpkg/info|lib/apt)|tmp|run|dev|proc|sys|etc/ssl/certs|etc/ca-certificates)/') OR regexp_matches(path, '(^|/)(__pycache__|\.cache|\.npm|\.yarn)/') OR parse_filename(path) IN ('__pycache__', '.DS_Store', 'Thumbs.db', '.gitkeep', '.gitignore', '__init__.pyc') OR regexp_matches(path, '\.(py[cod]|dwarf|debug|la|g?mo|cache)$') THEN 'noise' WHEN suffix(path, '.a') THEN 'static-archive' WHEN regexp_matches(path, '\.(so|dylib|dll)$', 'i') THEN 'library' WHEN regexp_matches(path, '\.[jwe]ar$', 'i') THEN 'archive' WHEN regexp_matches(path, '\.(ya?ml|json|toml|ini|conf|cfg|pem|crt|cer|key|md|txt|rst|html?)$', 'i') THEN 'config' WHEN regexp_matches(head, '^(7F454C46|4D5A|FEEDFAC[EF]|C[EF]FAEDFE)') THEN 'executable' WHEN starts_with(head, '504B0304') THEN 'archive' WHEN starts_with(head, '2321') THEN 'script' ELSE 'unknown' END"


def contents(spark, sf_dir):
    return view(spark, sf_dir, "contents").withColumn("head", F.unhex("head"))


@query(f"SELECT ord, path, {KINDS} AS category FROM {CONTENTS}")
def content_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select("ord", "path", untracked.category(F.col("path"), F.col("head")).alias("category"))


@query(f"SELECT ord, path, size, category, size >= 4096 AND category IN ('executable', 'library') AS lookup FROM (SELECT *, {KINDS} AS category FROM {CONTENTS}) WHERE category NOT IN ('noise', 'static-archive', 'config', 'redundant')")
def untracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untracked.scanned(contents(spark, sf_dir))


NAMED = "CASE ord % 7 WHEN 0 THEN 'Node' WHEN 1 THEN 'python3' WHEN 2 THEN 'PostgreSQL' WHEN 3 THEN 'httpd' WHEN 4 THEN 'ubuntu' ELSE name END"


@query(f"SELECT bom_ref, coalesce(p.product, n.product) AS product, CASE coalesce(p.form, n.form) WHEN 1 THEN split_part(version, '.', 1) ELSE regexp_extract(version, '^[^.]*(\\.[^.]*)?') END AS cycle FROM (SELECT bom_ref, purl, version, {NAMED} AS name FROM {C}) c LEFT JOIN (VALUES ('pkg:apk/alpine', 'alpine', 2), ('pkg:deb/debian', 'debian', 1)) p(start, product, form) ON starts_with(purl, start) LEFT JOIN (VALUES ('node', 'nodejs', 1), ('python3', 'python', 2), ('postgresql', 'postgresql', 1), ('httpd', 'apache', 2), ('ubuntu', 'ubuntu', 2)) n(own, product, form) ON lower(name) = own WHERE coalesce(p.product, n.product) IS NOT NULL")
def lifecycle_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycles.products(view(spark, sf_dir, "components").withColumn("name", F.expr(NAMED)))


ATTEMPTS = "(SELECT o_custkey AS request, o_orderkey AS ord, CASE o_orderkey % 37 % 8 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 403 WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 200 ELSE 404 END WHEN 5 THEN CASE WHEN o_custkey % 5 > 0 THEN 404 END ELSE 404 END AS status FROM orders)"


@query(f"SELECT request, CASE WHEN bool_or(status = 200) THEN 'found' WHEN bool_or(status IS NULL OR status NOT IN (200, 404, 429) AND status < 500) THEN 'error' WHEN bool_or(status = 429 OR status >= 500) THEN 'transient' ELSE 'not-found' END AS outcome, min(ord) FILTER (WHERE status = 200) AS endpoint FROM {ATTEMPTS} GROUP BY 1")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS request", "o_orderkey AS ord", ATTEMPTS[ATTEMPTS.index("CASE o_orderkey") : ATTEMPTS.index(" FROM orders")])
    return enrichment.outcomes(attempts)


NOTED = "CASE ord % 4 WHEN 0 THEN concat('a=', name) WHEN 1 THEN concat(' a = ', version, '=x') WHEN 2 THEN '=none' ELSE 'nothing' END"


@query(f"SELECT bom_ref, 'by' AS name, 'scan' AS value FROM {C} UNION ALL SELECT bom_ref, 'version', '2' FROM {C} UNION ALL SELECT bom_ref, 'a', CASE ord % 4 WHEN 0 THEN name WHEN 1 THEN concat(' ', version, '=x') ELSE 'first' END FROM {C} UNION ALL SELECT bom_ref, 'supplier', supplier FROM {C}")
def property_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as properties, cleared by prefix, filled and stamped."""
    c = view(spark, sf_dir, "components")
    props = properties.from_annotations(F.array(F.lit("a=first"), F.lit("cpe:x=1"), F.lit("version=1"), F.expr(NOTED)))
    props = properties.filled(properties.cleared(props, "cpe:"), F.create_map(F.lit("a"), F.lit("later"), F.lit("supplier"), "supplier"))
    return properties.entries(c, "bom_ref", properties.stamped(props, "by", "scan", "version", "2"))


@query(f"SELECT bom_ref, concat_ws('|', CASE WHEN ord % 3 = 0 THEN concat('/e/', name) END, CASE WHEN ord % 2 = 0 THEN concat('/p0/', name) END, concat('/p1/', name)) AS paths FROM {C}")
def component_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "components")
    evidence = F.expr("array(CASE WHEN ord % 3 = 0 THEN concat('/e/', name) ELSE '' END)")
    props = F.expr("map('syft:location:1:path', concat('/p1/', name), 'syft:location:0:path', CASE WHEN ord % 2 = 0 THEN concat('/p0/', name) ELSE '' END, 'syft:location:0:layer', 'no path', 'other:path', 'no location')")
    return c.select("bom_ref", F.array_join(properties.locations(evidence, props), "|").alias("paths"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN concat(CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END, s_nationkey, '@sha256:00') ELSE concat(CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN '@sha256:ff' ELSE '' END) END AS base FROM supplier")
def base_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base image that labels name."""
    pinned = "CASE WHEN s_suppkey % 5 = 0 THEN '@sha256:00' ELSE '' END"
    new, old = f"CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('new', s_nationkey, {pinned}) END", f"CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('old', s_nationkey, {pinned}) END"
    labels = F.expr(f"map('{properties.BASE_NAMES[0]}', {new}, '{properties.BASE_NAMES[1]}', {old}, '{properties.BASE_DIGEST}', CASE WHEN s_suppkey % 2 = 0 THEN 'sha256:ff' ELSE '' END)")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", properties.base_reference(labels).alias("base"))


ANSWERS = "SELECT bom_ref AS key, s.source, s.priority, s.registered, s.network, CASE WHEN s.registered = 1 THEN (ord % 10) / 10.0 ELSE 0.6 + (ord % 2) / 5.0 END AS confidence"
SOURCES = [("pattern", 50, 0, False), ("local", 90, 1, False), ("api", 80, 2, True), ("dictionary", 100, 3, True), ("notices", 70, 4, True)]


@query("WITH a AS (" + ANSWERS + f" FROM {C} JOIN (VALUES " + ", ".join(f"('{n}', {p}, {r}, {str(w).lower()})" for n, p, r, w in SOURCES) + ") s(source, priority, registered, network) ON (ord + s.registered) % 3 > 0) SELECT key, source, confidence FROM a WHERE NOT network OR NOT EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND NOT b.network AND b.confidence >= 0.7 AND b.priority > a.priority)")
def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the sources that a hybrid resolver asks."""
    stated = ", ".join(f"named_struct('source', '{n}', 'priority', {p}, 'registered', {r}, 'network', {str(w).lower()})" for n, p, r, w in SOURCES)
    c = view(spark, sf_dir, "components").select("ord", "bom_ref", F.explode(F.expr(f"array({stated})")).alias("s")).filter("(ord + s.registered) % 3 > 0")
    answers = c.selectExpr(*[x.strip() for x in re.split(r",(?![^(]*\))", ANSWERS.removeprefix("SELECT "))])
    return resolving.resolve(answers).select("key", "source", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'registry' WHEN 1 THEN 'archive' WHEN 2 THEN 'layout' WHEN 3 THEN 'docker' WHEN 4 THEN 'unsupported' WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN 'archive' ELSE 'detect' END WHEN 6 THEN 'detect' ELSE 'empty' END AS source, CASE o_orderkey % 8 WHEN 0 THEN concat('r/', o_custkey) WHEN 1 THEN '/a.tar' WHEN 2 THEN '/dir://x' WHEN 3 THEN 'a:1' WHEN 4 THEN 'x' WHEN 5 THEN '/a.tar' WHEN 6 THEN 'HTTPS://h/x' ELSE '' END AS body FROM orders")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.expr("CASE o_orderkey % 8 WHEN 0 THEN concat('registry://r/', o_custkey) WHEN 1 THEN 'archive:///a.tar' WHEN 2 THEN 'oci:///dir://x' WHEN 3 THEN 'docker-daemon://a:1' WHEN 4 THEN 'ftp://x' WHEN 5 THEN '/a.tar' WHEN 6 THEN 'HTTPS://h/x' ELSE '' END")
    kind = F.expr("CASE WHEN o_orderkey % 8 = 5 AND o_custkey % 2 = 0 THEN 'file' END")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", resolving.image_source(reference, kind).alias("s")).select("o_orderkey", "s.source", "s.body")


STAMP = "concat(CAST(o_orderdate AS DATE), CASE o_orderkey % 5 WHEN 0 THEN 'T10:20:30Z' WHEN 1 THEN 'T10:20:30.250+02:00' WHEN 2 THEN 'T10:20:30' WHEN 3 THEN ' 10:20:30' ELSE 'T23:59:59-05:30' END)"


@query("SELECT o_orderkey, epoch_us(CAST(o_orderdate AS DATE)::TIMESTAMP) + CASE o_orderkey % 5 WHEN 0 THEN 37230000000 WHEN 1 THEN 30030250000 WHEN 2 THEN 37230000000 WHEN 4 THEN 106199000000 END AS micros FROM orders")
def document_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_micros(properties.moment(F.expr(STAMP))).alias("micros"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of metrics gives in the end, over all events at once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return streams.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
