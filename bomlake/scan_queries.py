"""Queries of the scan for files that no package accounts for: clusters, claims, decisions and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake.operators import claims, images
from bomlake.queries import KINDS, query

#: Files of an image, made of order lines: nested folders, some with manifests, some like source trees.
BASE = "CASE k % 6 WHEN 0 THEN concat('lib', k, '-1.', k % 7) WHEN 1 THEN concat('mod', k) WHEN 2 THEN concat('tool', k, '_2.', k % 5) WHEN 3 THEN concat('mod', k, '/inner', k % 4) WHEN 4 THEN concat('sqlite-version-3.', k) ELSE concat('x', k, '-v2') END"
NAME = "CASE kind WHEN 0 THEN CASE WHEN k % 4 = 1 THEN 'package.json' ELSE 'main.js' END WHEN 1 THEN 'Makefile' WHEN 2 THEN 'configure' WHEN 3 THEN 'README.md' WHEN 4 THEN concat('src/f', p % 40, '.c') WHEN 5 THEN concat('include/h', p % 40) WHEN 6 THEN 'LICENSE' WHEN 7 THEN concat('bin/run', p % 30) WHEN 8 THEN concat('lib', p % 50, '.so') WHEN 9 THEN concat('data', p % 90, '.cache') WHEN 10 THEN CASE WHEN k % 8 = 3 THEN 'inner.gemspec' ELSE 'run.sh' END ELSE concat('var/v', p % 200) END"
FILES = f"(SELECT min(ord) AS ord, path, max(size) AS size FROM (SELECT ord, concat('srv', k % 12, '/', {BASE}, '/', {NAME}) AS path, size FROM (SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey % 72 AS k, l_partkey AS p, l_partkey % (4 + l_orderkey % 15) AS kind, CAST(l_quantity AS BIGINT) * 512 AS size FROM {{0}})) GROUP BY path)"
#: What the manifests state; one in five can't be read.
ANCHORS = "(SELECT ord, path, root, 'npm' AS kind, CASE WHEN ord % 7 = 0 THEN '' ELSE concat('p-', own) END AS name, CASE WHEN ord % 3 = 0 THEN '' ELSE '1.0' END AS version, concat('pkg:npm/p-', own, CASE WHEN ord % 3 = 0 THEN '' ELSE '@1.0' END, '?root=', root) AS purl, 0.95 AS confidence, 'anchor:package.json' AS method FROM (SELECT ord, path, regexp_replace(path, '/[^/]*$', '') AS root, replace(replace(regexp_replace(regexp_replace(path, '/[^/]*$', ''), '^srv[0-9]+/', ''), '-', ''), '/', '') AS own FROM {0} f WHERE path LIKE '%/package.json' AND ord % 5 > 0) m)"
#: Components that are known: some of the clusters by package URL, some by name only, and places of packages.
KNOWN = "(SELECT CASE s_suppkey % 4 WHEN 0 THEN concat('pkg:npm/p-mod', s_suppkey % 72, '@1.0?x=1') WHEN 1 THEN concat('pkg:npm/p-mod', s_suppkey % 72, '@9') WHEN 2 THEN concat('pkg:generic/tool', s_suppkey % 72) ELSE '' END AS purl, CASE s_suppkey % 3 WHEN 0 THEN concat('/srv', s_suppkey % 12, '/mod', s_suppkey % 72, '/inner3/inner.gemspec') WHEN 1 THEN concat('./srv', s_suppkey % 12, '/tool', s_suppkey % 72, '_2.3/bin/run', s_suppkey % 30) ELSE 'package.json' END AS path FROM {0})"
#: Rules by their actions, in the scan's own vocabulary.
RULES = [("shared", "skip", "suffix", ".so"), ("variables", "mark_as_noise", "glob", "srv[1-5]/*/var/*"), ("old", "mark_as_redundant", "prefix", "srv7/"), ("main", "redundant_under_archive", "exact", "main.js"), ("scripts", "mark_as_noise", "regex", "run\\.sh$")]
HEAD = "CASE ord % 5 WHEN 0 THEN '7F454C46' WHEN 1 THEN '2321' WHEN 2 THEN '504B0304' ELSE '00' END"


def view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    name = f"bomlake_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {sql.format(name)}")


def image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, anchors and known components."""
    files = view(spark, sf_dir, FILES, "lineitem")
    return files, view(spark, sf_dir, ANCHORS.format(FILES), "lineitem"), view(spark, sf_dir, KNOWN, "supplier")


F_, A_, K_ = FILES.format("lineitem"), ANCHORS.format(FILES.format("lineitem")), KNOWN.format("supplier")
UP = "list_transform(range(1, len(string_split({0}, '/')) + 1), lambda n: array_to_string(string_split({0}, '/')[1:n], '/'))"
HELD = f"held AS (SELECT path, arg_max(root, len(root)) AS root FROM (SELECT path, unnest({UP.format('path')}) AS up FROM f) JOIN (SELECT DISTINCT root FROM a) ON root = up GROUP BY 1)"
POINTS = "CASE WHEN list_has_any(names, ['Makefile']) AND list_has_any(names, ['configure']) THEN 5 ELSE 0 END + CASE WHEN version <> '' THEN 5 ELSE 0 END + CASE WHEN list_contains(names, 'src') AND list_contains(names, 'include') THEN 3 ELSE 0 END + CASE WHEN list_contains(names, 'LICENSE') AND list_contains(names, 'README.md') THEN 2 ELSE 0 END + CASE WHEN n_files > 1000 THEN 3 WHEN n_files > 100 THEN 1 ELSE 0 END"
FORMS = [f.replace("\\d", "[0-9]") for f in images.NAME_FORMS]
STATED = lambda n: "coalesce(" + ", ".join(f"nullif(regexp_extract(split_part(dir, '/', -1), '{f}', {n}), '')" for f in FORMS) + ", '')"
DENSE = f"""seen AS (SELECT dir, count(*) AS n_files, sum(size) AS bytes, list(DISTINCT child) AS names, bool_or(claimed) AS any_claimed FROM (SELECT size, claimed, array_to_string(p[1:n], '/') AS dir, p[n + 1] AS child FROM (SELECT size, claimed, p, unnest(range(1, len(p))) AS n FROM (SELECT size, held.path IS NOT NULL AS claimed, string_split(f.path, '/') AS p FROM f LEFT JOIN held ON held.path = f.path))) GROUP BY 1),
    scored AS (SELECT *, {POINTS} AS score FROM (SELECT *, {STATED(1)} AS name, {STATED(2)} AS version FROM seen)),
    dense AS (SELECT split_part(dir, '/', 1) AS top, arg_min(dir, dir) AS dir, arg_min(name, dir) AS name, arg_min(version, dir) AS version, arg_min(score, dir) AS score, arg_min(n_files, dir) AS n_files, arg_min(bytes, dir) AS bytes FROM scored WHERE len(names) >= 3 AND score >= 7 AND NOT any_claimed GROUP BY 1)"""
CLUSTERS = f"""f AS (SELECT * FROM {F_}), a AS (SELECT * FROM {A_}), {HELD}, {DENSE},
    c AS (SELECT 0 AS stage, -len(string_split(root, '/')) AS depth, ord, '' AS dir, root, kind, name, version, purl, CAST(confidence AS DOUBLE) AS confidence, method, a.path AS anchor, CASE WHEN row_number() OVER (PARTITION BY root ORDER BY ord, a.path) = 1 THEN coalesce(n, 0) ELSE 0 END AS n_files, CASE WHEN row_number() OVER (PARTITION BY root ORDER BY ord, a.path) = 1 THEN coalesce(b, 0) ELSE 0 END AS bytes
        FROM a LEFT JOIN (SELECT root, count(*) AS n, CAST(sum(size) AS BIGINT) AS b FROM held JOIN f USING (path) GROUP BY 1) USING (root)
        UNION ALL SELECT 1, 0, 0, dir, dir, 'generic', nm, version, concat('pkg:generic/', nm, CASE WHEN version <> '' THEN concat('@', version) ELSE '' END, '?root=/', dir), least(1.0, score / 10.0), concat('density:score=', score), '', n_files, CAST(bytes AS BIGINT) FROM (SELECT *, CASE WHEN name <> '' THEN name ELSE split_part(dir, '/', -1) END AS nm FROM dense))"""


@query(f"WITH {CLUSTERS} SELECT root, kind, name, version, purl, confidence, method, anchor, n_files, bytes FROM c")
def scan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by manifests and by density; a claimed directory is never a dense one."""
    files, anchors, _ = image(spark, sf_dir)
    return claims.clusters(files, anchors).drop("place")


@query(f"""WITH {CLUSTERS}, k AS (SELECT split_part(purl, '?', 1) AS key, split_part(split_part(substr(purl, 5), '?', 1), '@', 1) AS coord FROM {K_} WHERE purl <> '')
    SELECT concat('cluster-', regexp_replace(concat_ws('-', kind, name, version), '[^A-Za-z0-9.-]', '-', 'g')) AS bom_ref, 'library' AS ctype, root, name, version, purl, n_files FROM (SELECT *, row_number() OVER (PARTITION BY split_part(purl, '?', 1) ORDER BY stage, depth, ord, dir, root) AS nth FROM c WHERE name <> '' AND split_part(purl, '?', 1) NOT IN (SELECT key FROM k) AND split_part(split_part(substr(purl, 5), '?', 1), '@', 1) NOT IN (SELECT coord FROM k)) WHERE nth = 1""")
def scan_cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that no known component accounts for, the first of equal ones."""
    files, anchors, known = image(spark, sf_dir)
    return claims.unknown_clusters(claims.clusters(files, anchors), known).select("bom_ref", "ctype", "root", "name", "version", "purl", "n_files")


REDUNDANT = f"""p AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '^\\./', ''), '^/', '') AS path FROM {K_}),
    folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM p WHERE path LIKE '%/%' AND (path LIKE '%.gemspec' OR split_part(path, '/', -1) IN {claims.MANIFESTS})),
    r AS (SELECT DISTINCT path FROM f WHERE path IN (SELECT path FROM p) OR EXISTS (SELECT 1 FROM folders WHERE f.path = folder OR starts_with(f.path, concat(folder, '/'))))"""


@query(f"WITH f AS (SELECT * FROM {F_}), {REDUNDANT} SELECT path FROM r")
def scan_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that known components name, or that lie with a known package."""
    files, _, known = image(spark, sf_dir)
    return claims.redundant(files, known)


RULED = "CASE WHEN split_part(path, '/', -1) = 'main.js' THEN 'main' WHEN starts_with(path, 'srv7/') THEN 'old' WHEN path LIKE '%.so' THEN 'shared' WHEN regexp_matches(path, '^srv[1-5]/[^/]*/var/[^/]*$') THEN 'variables' WHEN regexp_matches(path, 'run\\.sh$') THEN 'scripts' ELSE '' END"
ACTION = "CASE {0} WHEN 'main' THEN 'redundant_under_archive' WHEN 'shared' THEN 'skip' WHEN 'old' THEN 'mark_as_redundant' WHEN 'variables' THEN 'mark_as_noise' WHEN 'scripts' THEN 'mark_as_noise' ELSE 'keep' END"
DOCS = f"(split_part(path, '/', -1) IN {images.DOC_NAMES} OR lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN {images.DOC_SUFFIXES})"


def decisions_sql(noise: bool, redundant: bool) -> str:
    no, re = (str(not x).lower() for x in (noise, redundant))
    return f"""{CLUSTERS}, {REDUNDANT}, roots AS (SELECT DISTINCT root FROM c WHERE root <> '' AND kind = 'npm'),
    inside AS (SELECT path, arg_max(root, len(root)) AS cluster FROM (SELECT path, unnest({UP.format('path')}) AS up FROM f) JOIN roots ON root = up GROUP BY 1),
    g AS (SELECT *, CASE WHEN redundant THEN 'redundant' WHEN docs THEN 'noise' ELSE '' END AS reason, {ACTION.format('ruled')} AS action, {KINDS} AS category FROM (SELECT f.*, {HEAD} AS head, coalesce(cluster, '') AS cluster, f.path IN (SELECT path FROM r) AS redundant, {DOCS.replace('path', 'f.path')} AS docs, {RULED.replace('path', 'f.path')} AS ruled FROM f LEFT JOIN inside ON inside.path = f.path)),
    d AS (SELECT *, CASE WHEN cluster <> '' THEN 'cluster' WHEN redundant AND {re} THEN 'redundant' WHEN docs AND {no} THEN 'noise' WHEN reason = '' AND action IN ('skip', 'redundant_under_archive') THEN 'rule' WHEN reason = '' AND action = 'mark_as_noise' AND {no} THEN 'noise' WHEN reason = '' AND action = 'mark_as_redundant' AND {re} THEN 'redundant' WHEN category IN ('noise', 'static-archive', 'config', 'redundant') THEN 'classifier' ELSE 'added' END AS decision,
        CASE WHEN cluster = '' AND reason = '' AND (action IN ('skip', 'redundant_under_archive') OR action = 'mark_as_noise' AND NOT {no} OR action = 'mark_as_redundant' AND NOT {re}) THEN ruled ELSE '' END AS rule, cluster = '' AND reason = '' AS free FROM g)"""


def decisions(spark: SparkSession, sf_dir: str, noise: bool, redundant: bool) -> DataFrame:
    files, anchors, known = image(spark, sf_dir)
    files = files.withColumn("head", F.unhex(F.expr(HEAD)))
    return claims.decided(files, anchors, known, RULES, include_noise=noise, include_redundant=redundant)


@query(f"WITH {decisions_sql(True, True)} SELECT ord, path, cluster, rule, decision, category, CASE WHEN decision <> 'added' THEN '' WHEN reason <> '' THEN reason WHEN action = 'mark_as_noise' THEN concat('noise:', ruled) WHEN action = 'mark_as_redundant' THEN concat('redundant:', ruled) ELSE '' END AS bypass FROM d")
def scan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan does with each file, and why, where noise and redundant files are let pass."""
    return decisions(spark, sf_dir, True, True).select("ord", "path", "cluster", "rule", "decision", "category", "bypass")


@query(f"WITH {decisions_sql(False, False)} SELECT count(*) AS scanned, count(*) FILTER (WHERE decision = 'added') AS added, count(*) FILTER (WHERE cluster = '' AND (redundant OR free AND action = 'mark_as_redundant')) AS redundant, count(*) FILTER (WHERE cluster = '' AND (docs AND NOT redundant OR free AND action = 'mark_as_noise')) AS noise, count(*) FILTER (WHERE decision = 'classifier') AS by_classifier, count(*) FILTER (WHERE decision = 'rule') AS by_rule, count(*) FILTER (WHERE decision = 'cluster') AS by_cluster FROM d")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's counters, nothing let pass."""
    d = decisions(spark, sf_dir, False, False)
    return d.agg(*claims.counters(d))


@query(f"WITH {decisions_sql(True, False)} SELECT 'category' AS what, category AS name, count(*) AS n FROM d WHERE decision = 'added' GROUP BY ALL UNION ALL SELECT 'rule', rule, count(*) FROM d WHERE rule <> '' GROUP BY ALL UNION ALL SELECT 'cluster', cluster, count(*) FROM d WHERE cluster <> '' GROUP BY ALL")
def scan_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by category, rule and cluster."""
    return claims.tally(decisions(spark, sf_dir, True, False))


@query(f"SELECT bom_ref, name, version FROM (SELECT p_partkey AS bom_ref, {STATED(1)} AS name, {STATED(2)} AS version FROM (SELECT p_partkey, concat('opt/', replace(p_name, ' ', '-'), CASE p_partkey % 9 WHEN 0 THEN '-version-3.44.0' WHEN 1 THEN '-v4.40.5' WHEN 2 THEN '_4.19.0' WHEN 3 THEN '-1.75.0-beta' WHEN 4 THEN '-7' WHEN 5 THEN '_v2.3' WHEN 6 THEN '-v' WHEN 7 THEN '_x_1' ELSE '' END) AS dir FROM part))")
def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and versions that directories' names state."""
    end = "CASE p_partkey % 9 WHEN 0 THEN '-version-3.44.0' WHEN 1 THEN '-v4.40.5' WHEN 2 THEN '_4.19.0' WHEN 3 THEN '-1.75.0-beta' WHEN 4 THEN '-7' WHEN 5 THEN '_v2.3' WHEN 6 THEN '-v' WHEN 7 THEN '_x_1' ELSE '' END"
    name, version = images.named_version(F.concat(F.translate("p_name", " ", "-"), F.expr(end)))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("bom_ref"), name.alias("name"), version.alias("version"))
