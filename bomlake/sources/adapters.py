"""Driver tables as the views that the domain operators take; the expressions are SQL valid in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TYPE = "CASE WHEN p_type LIKE 'ECONOMY%' THEN 'application' WHEN p_type LIKE 'SMALL%' THEN 'file' WHEN p_type LIKE 'PROMO%' THEN 'framework' WHEN p_type LIKE 'LARGE%' THEN 'operating-system' ELSE 'library' END"
ECOSYSTEM = "CASE p_partkey % 8 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'maven' WHEN 3 THEN 'golang' WHEN 4 THEN 'deb' WHEN 5 THEN 'apk' WHEN 6 THEN 'cargo' ELSE 'generic' END"
BRAND = "lower(replace(p_brand, '#', ''))"

#: view -> (table, [columns of a first step], [columns of a second step])
VIEWS = {
    "components": (
        "part",
        ["p_partkey AS ord", "concat('part-', p_partkey) AS bom_ref", f"{TYPE} AS ctype", f"{ECOSYSTEM} AS eco", f"{BRAND} AS brand", "replace(p_name, ' ', '-') AS name", "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(p_size % 5, '.', p_partkey % 3, '.0') END AS version", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS supplier"],
        ["ord", "bom_ref", "ctype", "eco", "CASE eco WHEN 'maven' THEN concat('org.', brand) WHEN 'golang' THEN concat('github.com/', brand) WHEN 'deb' THEN 'debian' WHEN 'apk' THEN 'alpine' ELSE '' END AS ns", "name", "version", "supplier"],
        ["ord", "bom_ref", "ctype", "eco", "ns", "name", "version", "supplier", "CASE WHEN ord % 11 = 0 THEN '' ELSE concat('pkg:', eco, '/', CASE WHEN ns = '' THEN '' ELSE concat(ns, '/') END, name, CASE WHEN version = '' THEN '' ELSE concat('@', version) END, CASE WHEN ord % 2 = 0 THEN '?arch=amd64' ELSE '' END) END AS purl"],
        ["ord", "bom_ref", "ctype", "eco", "ns", "name", "version", "supplier", "purl", "CASE WHEN ord % 11 = 0 AND ord % 4 = 0 THEN concat(CASE WHEN ord % 8 = 0 THEN ' CPE:2.3:a:Acme:p' ELSE 'cpe:2.3:a:acme:p' END, ord % 40, ':1.0') WHEN ord % 6 = 0 THEN concat('cpe:2.3:a:acme:q', ord, ':1.0') ELSE '' END AS cpe", "CASE WHEN ord % 4 = 1 THEN concat(CASE WHEN ord % 8 = 1 THEN 'AB' ELSE 'ab' END, ord % 30) ELSE '' END AS sha256", "ord % 4 AS n_locations"],
    ),
    "trees": (
        "lineitem",
        ["l_orderkey % 60 AS k", "l_partkey AS p", "l_partkey % (2 + l_orderkey % 14) AS kind", "l_quantity AS size"],
        ["concat('opt', k % 20, '/', CASE WHEN k % 3 = 0 THEN concat('tool', k, CASE k % 5 WHEN 0 THEN '-1.' WHEN 1 THEN '_v2.' WHEN 2 THEN '-version-3.' WHEN 3 THEN '-v4.' ELSE '_5.' END, k % 7) ELSE concat('app', k) END, '/', CASE kind WHEN 1 THEN 'Makefile' WHEN 2 THEN 'configure.ac' WHEN 3 THEN 'README.md' WHEN 4 THEN concat('Src/f', p % 40, '.c') WHEN 5 THEN concat('include/h', p % 40, '.h') WHEN 6 THEN 'LICENCE' WHEN 7 THEN concat('tests/t', p % 9) WHEN 8 THEN 'CMakeLists.txt' ELSE concat('x', p % (1 + k * 3)) END) AS path", "size"],
    ),
    "edges": ("lineitem", ["concat('order-', l_orderkey) AS src", "concat('part-', l_partkey) AS dst", "CASE WHEN l_linenumber % 5 = 0 THEN 'contains' ELSE 'depends-on' END AS rel", "l_orderkey * 10 + l_linenumber AS ord"]),
    "layer_entries": ("lineitem", ["l_linenumber - 1 AS layer", "l_orderkey * 10 + l_linenumber AS seq", "concat('opt/app', l_partkey % 20, '/f', l_partkey) AS path", "CASE WHEN l_returnflag = 'R' THEN 'wh' ELSE 'add' END AS op"]),
    "files": ("documents", ["doc_id AS ord", "CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'target' END AS img", "concat('usr/share/', lang, '/', doc_id % 301, '.txt') AS path", "{sha}(text{bits}) AS h", "n_chars AS size"]),
    "paths": ("pages", ["page_id AS ord", r"regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path"]),
    "contents": (
        "part",
        [
            "p_partkey AS ord",
            "concat(CASE p_partkey % 9 WHEN 0 THEN '/usr/share/doc/' WHEN 1 THEN '/opt/__pycache__/' WHEN 2 THEN 'opt/tmp/' WHEN 3 THEN 'tmp/' WHEN 4 THEN '/home/.npm/' ELSE '/opt/app/' END, CASE WHEN p_partkey % 31 = 0 THEN 'Thumbs.db' ELSE concat(replace(p_name, ' ', '-'), CASE p_partkey % 14 WHEN 0 THEN '.so' WHEN 1 THEN '.JAR' WHEN 2 THEN '.zip' WHEN 3 THEN '.yaml' WHEN 4 THEN '.a' WHEN 5 THEN '.A' WHEN 6 THEN '.debug' WHEN 7 THEN '.so.1' WHEN 8 THEN '.d/run' WHEN 9 THEN '.HTM' ELSE '' END) END) AS path",
            "CASE p_partkey % 11 WHEN 0 THEN '7F454C4602' WHEN 1 THEN '4D5A90' WHEN 2 THEN 'FEEDFACF07' WHEN 3 THEN 'CAFEBABE' WHEN 4 THEN '504B0304' WHEN 5 THEN '2321' WHEN 6 THEN '' WHEN 7 THEN '504B' ELSE '48690A' END AS head",
            "p_partkey * 41 % 9001 AS size",
        ],
    ),
    "metrics": ("events", ["event_id AS ord", "event_type AS label", "value", "ts"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, *steps = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for step in steps:
        df = df.selectExpr(*[x.replace("{sha}", "sha2").replace("{bits}", ", 256") for x in step])
    return df


def sql(name: str) -> str:
    """The view as a DuckDB subquery."""
    table, *steps = VIEWS[name]
    out = table
    for step in steps:
        out = f"(SELECT {', '.join(step)} FROM {out})"
    return out.replace("{sha}", "sha256").replace("{bits}", "")
