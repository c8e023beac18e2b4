"""Queries of whole documents: written as CycloneDX, SPDX and SARIF, read back, and typed fields from and to properties."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlake import __version__
from bomlake.operators import typed
from bomlake.plans.tables import kept
from bomlake.queries import C, query, view
from bomlake.sources import records, writers

#: Documents of 48 components each: a twelfth of them are at the top, the others below one, or two levels down.
CREATED = "2024-02-03T04:05:06Z"
T, MID, LEAF = "floor(ord % 48 / 12)", "floor(ord % 12 / 4)", "ord % 4"
PAD = "lpad(CAST(CAST({0} AS BIGINT) AS {{t}}), 8, '0')"
PLACE = f"concat('/', {PAD.format(T)}, CASE WHEN {MID} > 0 THEN concat('/', {PAD.format(f'{MID} * 10')}) ELSE '' END, CASE WHEN {LEAF} > 0 THEN concat('/', {PAD.format(LEAF)}) ELSE '' END)"
#: Where a reader finds the same component: siblings are numbered without gaps.
READ = f"concat('/', {PAD.format(T)}, CASE WHEN {MID} > 0 THEN concat('/', {PAD.format(f'{MID} + 2')}) ELSE '' END, CASE WHEN {LEAF} > 0 THEN concat('/', {PAD.format(f'{LEAF} - 1')}) ELSE '' END)"
SBOM = "concat('bom-', CAST(floor(ord / 48) AS BIGINT))"
FIRST_CPE, MORE_CPE = "cpe", "CASE WHEN cpe <> '' AND ord % 4 = 0 THEN concat('cpe:2.3:a:more:', ord) ELSE '' END"
LICENCE = "CASE ord % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT OR Apache-2.0' WHEN 2 THEN 'Some terms' ELSE '' END"
METHOD = "CASE WHEN ord % 3 = 0 THEN 'purl' ELSE '' END"
ORIGIN = "CASE ord % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'app' ELSE '' END"
LAYERED = "ord % 2 = 0"


def bill(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, records and edges."""
    c = view(spark, sf_dir, "components")
    t = {"t": "string"}
    none = "array()"
    rows = c.selectExpr(
        "ord", f"{SBOM} AS sbom_id", f"{PLACE.format(**t)} AS place", "bom_ref", "ctype", "ns AS grp", "name", "version", "CASE WHEN ord % 7 = 0 THEN 'what it is' ELSE '' END AS description", "'' AS scope", "purl", "CASE WHEN ord % 4 = 0 THEN 'someone' ELSE '' END AS author", "'' AS publisher", "'' AS copyright", "supplier",
        f"filter(array({FIRST_CPE}, {MORE_CPE}), x -> x <> '') AS cpes", f"CASE WHEN sha256 = '' THEN cast({none} AS {records.HASHES}) ELSE array(named_struct('alg', 'sha256', 'value', sha256), named_struct('alg', 'blake3', 'value', 'ff')) END AS hashes",
        f"CASE ord % 5 WHEN 0 THEN array(named_struct('id', 'MIT', 'name', '', 'expression', '', 'url', 'http://x')) WHEN 1 THEN array(named_struct('id', '', 'name', '', 'expression', 'MIT OR Apache-2.0', 'url', '')) WHEN 2 THEN array(named_struct('id', '', 'name', 'Some terms', 'expression', '', 'url', ''), named_struct('id', '', 'name', '', 'expression', '', 'url', '')) ELSE cast({none} AS {records.LICENCES}) END AS licences",
        f"CASE WHEN n_locations > 0 THEN named_struct('method', {METHOD}, 'confidence', cast(CASE WHEN ord % 3 = 0 THEN 0.5 ELSE 0 END AS float), 'locations', array(concat('/opt/', name))) END AS evidence",
        "map('z', name, 'a', 'first') AS props", f"{ORIGIN} AS origin", f"CASE WHEN {LAYERED} THEN named_struct('digest', CASE WHEN ord % 4 = 0 THEN 'sha256:aa' ELSE '' END, 'index', cast(ord % 9 AS int), 'line', '', 'added_by', 'RUN x') END AS layer",
    )
    documents = rows.select("sbom_id").distinct().selectExpr("sbom_id", f"timestamp '{CREATED}' AS created", "array('an author') AS authors", "array(named_struct('vendor', 'maker', 'name', 'scanner', 'version', '1.0')) AS tools", "map('k', 'v') AS props", "map('own', 'w') AS own_props")
    edges = rows.selectExpr("sbom_id", "ord", "explode(array(named_struct('n', ord * 2, 'src', bom_ref, 'dst', concat('part-', ord + 97), 'rel', CASE ord % 5 WHEN 0 THEN 'contains' WHEN 1 THEN 'unknown' ELSE 'depends-on' END), named_struct('n', ord * 2 + 1, 'src', concat('hub-', ord % 3), 'dst', bom_ref, 'rel', CASE ord % 4 WHEN 0 THEN 'provides' ELSE 'depends-on' END))) AS e").selectExpr("sbom_id", "e.n AS ord", "e.src", "e.dst", "e.rel")
    return documents, rows.drop("ord"), edges


def field(name: str, value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN concat(',\"{name}\":', to_json({value})) ELSE '' END"


def entries(*pairs: tuple[str, str, str]) -> str:
    """A list of properties in order of their keys: (key, value, condition)."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN concat({{p}}'{k}'{{m}}, {v}, {{e}}) END" for k, v, c in sorted(pairs)) + "], lambda x: x IS NOT NULL), ',')"


TYPED = [("a", "'first'", "true"), ("z", "name", "true"), ("bom:origin", ORIGIN, f"{ORIGIN} <> ''"), ("bom:layer:digest", "'sha256:aa'", "ord % 4 = 0"), ("bom:layer:index", "ord % 9", LAYERED), ("bom:layer:added-by", "'RUN x'", LAYERED)]
EXTRA = ("bom:cpe:1", MORE_CPE, f"{MORE_CPE} <> ''")
PROPS = entries(*TYPED, EXTRA).replace("{p}", "'{\"name\":\"', ").replace("{m}", ", '\",\"value\":\"'").replace("{e}", "'\"}'")
OWN = (
    "concat('{\"bom-ref\":', to_json(bom_ref), ',\"type\":\"', ctype, '\"', " + field("group", "ns") + ", ',\"name\":', to_json(name), " + field("version", "version")
    + ", CASE WHEN ord % 7 = 0 THEN ',\"description\":\"what it is\"' ELSE '' END, CASE WHEN ord % 4 = 0 THEN ',\"author\":\"someone\"' ELSE '' END, " + field("purl", "purl") + ", " + field("cpe", "cpe")
    + ", CASE WHEN supplier <> '' THEN concat(',\"supplier\":{\"name\":', to_json(supplier), '}') ELSE '' END, CASE WHEN sha256 <> '' THEN concat(',\"hashes\":[{\"alg\":\"SHA-256\",\"content\":\"', sha256, '\"},{\"alg\":\"BLAKE3\",\"content\":\"ff\"}]') ELSE '' END, "
    "CASE ord % 5 WHEN 0 THEN ',\"licenses\":[{\"license\":{\"id\":\"MIT\",\"url\":\"http://x\"}}]' WHEN 1 THEN ',\"licenses\":[{\"expression\":\"MIT OR Apache-2.0\"}]' WHEN 2 THEN ',\"licenses\":[{\"license\":{\"name\":\"Some terms\"}}]' ELSE '' END, "
    "CASE WHEN n_locations > 0 THEN concat(',\"evidence\":{', CASE WHEN ord % 3 = 0 THEN '\"identity\":[{\"field\":\"purl\",\"confidence\":0.5}],' ELSE '' END, '\"occurrences\":[{\"location\":\"/opt/', name, '\"}]}') ELSE '' END, "
    f"',\"properties\":[', {PROPS}, ']')"
)
PLACED = f"(SELECT *, {SBOM} AS sbom_id, {PLACE.format(t='VARCHAR')} AS place, {READ.format(t='VARCHAR')} AS read_at FROM {C})"
NESTED = f"""own AS (SELECT sbom_id, place, regexp_extract(place, '^(.*)/', 1) AS up, len(place) // 9 AS depth, {OWN} AS j FROM {PLACED}),
    three AS (SELECT sbom_id, up, string_agg(concat(j, '}}'), ',' ORDER BY place) AS kids FROM own WHERE depth = 3 GROUP BY 1, 2),
    two AS (SELECT o.sbom_id, o.up, string_agg(concat(j, CASE WHEN kids IS NULL THEN '' ELSE concat(',"components":[', kids, ']') END, '}}'), ',' ORDER BY place) AS kids FROM own o LEFT JOIN three k ON o.sbom_id = k.sbom_id AND o.place = k.up WHERE depth = 2 GROUP BY 1, 2),
    one AS (SELECT o.sbom_id, string_agg(concat(j, CASE WHEN kids IS NULL THEN '' ELSE concat(',"components":[', kids, ']') END, '}}'), ',' ORDER BY place) AS body FROM own o LEFT JOIN two k ON o.sbom_id = k.sbom_id AND o.place = k.up WHERE depth = 1 GROUP BY 1)"""
EDGED = f"(SELECT sbom_id, ord * 2 AS n, bom_ref AS src, concat('part-', ord + 97) AS dst, CASE ord % 5 WHEN 0 THEN 'contains' WHEN 1 THEN 'unknown' ELSE 'depends-on' END AS rel FROM {PLACED} UNION ALL SELECT sbom_id, ord * 2 + 1, concat('hub-', ord % 3), bom_ref, CASE ord % 4 WHEN 0 THEN 'provides' ELSE 'depends-on' END FROM {PLACED})"
DEPENDENCIES = f"""by_source AS (SELECT sbom_id, src, min(n) AS first, string_agg(concat('"', dst, '"'), ',' ORDER BY n) FILTER (WHERE rel = 'depends-on') AS needs, string_agg(concat('"', dst, '"'), ',' ORDER BY n) FILTER (WHERE rel = 'provides') AS gives FROM {EDGED} GROUP BY 1, 2),
    deps AS (SELECT sbom_id, string_agg(concat('{{"ref":"', src, '"', CASE WHEN needs IS NULL THEN '' ELSE concat(',"dependsOn":[', needs, ']') END, CASE WHEN gives IS NULL THEN '' ELSE concat(',"provides":[', gives, ']') END, '}}'), ',' ORDER BY first) AS deps FROM by_source GROUP BY 1)"""
HEAD = '{"bomFormat":"CycloneDX","specVersion":"1.6","version":1,"metadata":{"timestamp":"' + CREATED + '","authors":[{"name":"an author"}],"tools":{"components":[{"type":"application","name":"scanner","version":"1.0","supplier":{"name":"maker"}}]},"properties":[{"name":"k","value":"v"}]},"components":['


@query(f"WITH {NESTED}, {DEPENDENCIES} SELECT sbom_id, concat('{HEAD}', body, '],\"dependencies\":[', deps, '],\"properties\":[{{\"name\":\"own\",\"value\":\"w\"}}]}}') AS text FROM one JOIN deps USING (sbom_id)")
def cyclonedx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as CycloneDX documents with nested components, dependencies, metadata and properties."""
    return writers.assembled(writers.cyclonedx(*bill(spark, sf_dir)))


TOOL = f"Tool: bomlake-{__version__}"
NOTE = f"{{\"annotationDate\":\"{CREATED}\",\"annotationType\":\"OTHER\",\"annotator\":\"{TOOL}\",\"comment\":\""
NOTES = entries(*TYPED).replace("{p}", f"'{NOTE}', ").replace("{m}", ", '='").replace("{e}", "'\"}'")
SAID = "CASE ord % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT OR Apache-2.0' WHEN 2 THEN 'Some terms' ELSE '' END"
PACKAGE = (
    "concat('{\"SPDXID\":\"SPDXRef-', bom_ref, '\",\"name\":', to_json(name), " + field("versionInfo", "version") + ", CASE WHEN supplier <> '' THEN concat(',\"supplier\":\"Organization: ', supplier, '\"') ELSE '' END, ',\"downloadLocation\":\"NOASSERTION\",\"filesAnalyzed\":false', "
    "CASE WHEN sha256 <> '' THEN concat(',\"checksums\":[{\"algorithm\":\"SHA256\",\"checksumValue\":\"', sha256, '\"}]') ELSE '' END, " + f"CASE WHEN {SAID} <> '' THEN concat(',\"licenseConcluded\":\"', {SAID}, '\",\"licenseDeclared\":\"', {SAID}, '\"') ELSE '' END, "
    "CASE WHEN ord % 7 = 0 THEN ',\"description\":\"what it is\"' ELSE '' END, CASE WHEN purl <> '' OR cpe <> '' THEN concat(',\"externalRefs\":[', array_to_string(list_filter([CASE WHEN purl <> '' THEN concat('{\"referenceCategory\":\"PACKAGE-MANAGER\",\"referenceType\":\"purl\",\"referenceLocator\":', to_json(purl), '}') END, "
    + ", ".join(f"CASE WHEN {x} <> '' THEN concat('{{\"referenceCategory\":\"SECURITY\",\"referenceType\":\"cpe23Type\",\"referenceLocator\":', to_json({x}), '}}') END" for x in ("cpe", MORE_CPE)) + "], lambda x: x IS NOT NULL), ','), ']') ELSE '' END, "
    f"',\"annotations\":[', {NOTES}, ']}}')"
)
RELATION = "concat('{{\"spdxElementId\":\"SPDXRef-', {0}, '\",\"relationshipType\":\"{1}\",\"relatedSpdxElement\":\"SPDXRef-', {2}, '\"}}')"


@query(f"""WITH p AS (SELECT *, regexp_extract(place, '^(.*)/', 1) AS up, {PACKAGE} AS j FROM {PLACED}),
    r AS (SELECT c.sbom_id, concat('0', c.place, '/~') AS k, {RELATION.format('p.bom_ref', 'CONTAINS', 'c.bom_ref')} AS j FROM p c JOIN p ON p.sbom_id = c.sbom_id AND p.place = c.up
        UNION ALL SELECT sbom_id, concat('1', place), {RELATION.format("'DOCUMENT'", 'DESCRIBES', 'bom_ref')} FROM p WHERE up = ''
        UNION ALL SELECT sbom_id, concat('2', lpad(CAST(n AS VARCHAR), 20, '0')), CASE rel WHEN 'depends-on' THEN {RELATION.format('src', 'DEPENDS_ON', 'dst')} WHEN 'provides' THEN {RELATION.format('src', 'DEPENDENCY_OF', 'dst')} ELSE {RELATION.format('src', 'CONTAINS', 'dst')} END FROM {EDGED} WHERE rel <> 'unknown')
    SELECT sbom_id, concat('{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"bomlake-sbom","documentNamespace":"https://spdx.org/spdxdocs/bomlake/bomlake-sbom","creationInfo":{{"licenseListVersion":"3.23","creators":["{TOOL}"],"created":"{CREATED}"}},"annotations":[{NOTE}own=w"}}],"packages":[', (SELECT string_agg(j, ',' ORDER BY place) FROM p WHERE p.sbom_id = d.sbom_id), '],"relationships":[', (SELECT string_agg(j, ',' ORDER BY k) FROM r WHERE r.sbom_id = d.sbom_id), ']}}') AS text
    FROM (SELECT DISTINCT sbom_id FROM p) d""")
def spdx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as SPDX documents: packages before their children, containment, what is described, other relations."""
    return writers.assembled(writers.spdx(*bill(spark, sf_dir), created=CREATED))


LISTED = "concat_ws(';', {0})"
BACK = "sbom_id, place, bom_ref, ctype, grp, name, version, description, purl, author, supplier, cpes, hashes, licences, evidence, props, origin, layer"


def told(rows: DataFrame) -> DataFrame:
    """A record's columns as texts."""
    return rows.select(
        "sbom_id", "place", "bom_ref", "ctype", "grp", "name", "version", "description", "purl", "author", "supplier", F.array_join("cpes", ";").alias("cpes"), F.array_join(F.transform("hashes", lambda h: F.concat_ws("=", h["alg"], h["value"])), ";").alias("hashes"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws("|", x["id"], x["name"], x["expression"], x["url"])), ";").alias("licences"), F.coalesce(F.concat_ws("|", "evidence.method", F.col("evidence.confidence").cast("double"), F.array_join("evidence.locations", ";")), F.lit("")).alias("evidence"),
        F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"), "origin", F.coalesce(F.concat_ws("|", "layer.digest", "layer.index", "layer.line", "layer.added_by"), F.lit("")).alias("layer"),
    )


BOTH_CPES = f"concat_ws(';', CASE WHEN cpe <> '' THEN cpe END, CASE WHEN {MORE_CPE} <> '' THEN {MORE_CPE} END)"
LAYER_TEXT = f"CASE WHEN {LAYERED} THEN concat(CASE WHEN ord % 4 = 0 THEN 'sha256:aa' ELSE '' END, '|', ord % 9, '||RUN x') ELSE '' END"


@query(f"SELECT sbom_id, read_at AS place, bom_ref, ctype, ns AS grp, name, version, CASE WHEN ord % 7 = 0 THEN 'what it is' ELSE '' END AS description, purl, CASE WHEN ord % 4 = 0 THEN 'someone' ELSE '' END AS author, supplier, {BOTH_CPES} AS cpes, CASE WHEN sha256 <> '' THEN concat('sha256=', sha256, ';blake3=ff') ELSE '' END AS hashes, CASE ord % 5 WHEN 0 THEN 'MIT|||http://x' WHEN 1 THEN '||MIT OR Apache-2.0|' WHEN 2 THEN '|Some terms||' ELSE '' END AS licences, CASE WHEN n_locations > 0 THEN concat(CASE WHEN ord % 3 = 0 THEN 'purl|0.5|' ELSE '|0.0|' END, '/opt/', name) ELSE '' END AS evidence, concat('a=first;z=', name) AS props, {ORIGIN} AS origin, {LAYER_TEXT} AS layer FROM {PLACED}")
def cyclonedx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are read from the CycloneDX documents written of them."""
    texts = kept(writers.assembled(writers.cyclonedx(*bill(spark, sf_dir)))).withColumn("format", F.lit("cyclonedx-json"))
    return told(records.cyclonedx_records(texts))


@query(f"SELECT sbom_id, regexp_replace(concat_ws('|', up_name, bom_ref), '^[|]', '') AS way, name, version, supplier, purl, {BOTH_CPES} AS cpes, CASE WHEN sha256 <> '' THEN concat('sha256=', sha256) ELSE '' END AS hashes, CASE ord % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT OR Apache-2.0' WHEN 2 THEN 'Some terms' ELSE '' END AS licence, {ORIGIN} AS origin, {LAYER_TEXT} AS layer FROM (SELECT c.*, coalesce(p.bom_ref, '') AS up_name FROM {PLACED} c LEFT JOIN {PLACED} p ON p.sbom_id = c.sbom_id AND p.place = regexp_extract(c.place, '^(.*)/', 1))")
def spdx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages read from the SPDX documents, put in their parents by containment."""
    documents, rows, edges = bill(spark, sf_dir)
    # edges that contain would put packages elsewhere: they are no part of the tree
    texts = kept(writers.assembled(writers.spdx(documents, rows, edges.filter("rel <> 'contains'"), CREATED))).withColumn("format", F.lit("spdx-json"))
    placed, _ = records.nested(records.spdx_packages(texts), records.spdx_relations(texts))
    up = placed.select("sbom_id", F.col("place").alias("above"), F.col("bom_ref").alias("up"))
    placed = placed.withColumn("above", F.regexp_extract("place", "^(.*)/", 1)).join(up, ["sbom_id", "above"], "left")
    return told(placed.withColumn("place", F.concat_ws("|", "up", "bom_ref"))).select("sbom_id", F.col("place").alias("way"), "name", "version", "supplier", "purl", "cpes", "hashes", F.regexp_extract("licences", r"^\|\|(.*)\|$", 1).alias("licence"), "origin", "layer")


@query(f"SELECT sbom_id, 2024 AS year, 'an author' AS author, 'maker|scanner|1.0' AS tool, 'k=v' AS props, n AS edges, given, hubs FROM (SELECT sbom_id, count(*) FILTER (WHERE rel IN ('depends-on', 'provides')) AS n, count(*) FILTER (WHERE rel = 'provides') AS given, count(DISTINCT src) FILTER (WHERE src LIKE 'hub%') AS hubs FROM {EDGED} GROUP BY 1)")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and relations that the documents state."""
    texts = kept(writers.assembled(writers.cyclonedx(*bill(spark, sf_dir)))).withColumn("format", F.lit("cyclonedx-json"))
    meta = records.cyclonedx_metadata(texts).select("sbom_id", F.year("created").alias("year"), F.array_join("authors", ";").alias("author"), F.array_join(F.transform("tools", lambda t: F.concat_ws("|", t["vendor"], t["name"], t["version"])), ";").alias("tool"), F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))
    edges = records.cyclonedx_relations(texts).groupBy("sbom_id").agg(F.count("*").alias("edges"), F.count_if(F.col("rel") == "provides").alias("given"), F.count_distinct(F.when(F.col("src").startswith("hub"), F.col("src"))).alias("hubs"))
    return meta.join(edges, "sbom_id")


#: What a component's map may hold: indexes that are no numbers, CPE names out of order, keys of others.
ODD_INDEX = "CASE ord % 4 WHEN 0 THEN 'seven' WHEN 1 THEN '7' END"


@query(f"SELECT bom_ref, {ORIGIN} AS origin, CASE WHEN ord % 4 < 2 OR ord % 3 = 0 THEN concat(CASE WHEN ord % 3 = 0 THEN 'd' ELSE '' END, '|', CASE WHEN ord % 4 = 1 THEN 7 ELSE 0 END, '||') ELSE '' END AS layer, concat('c1;c2;c10;', name) AS cpes, concat('a=1;bom:cpes=x;layer:index=', ord) AS props FROM {C}")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields from properties, with values that can't be read, and keys that only look alike."""
    c = view(spark, sf_dir, "components")
    pairs = [("bom:origin", ORIGIN), ("bom:layer:digest", "CASE WHEN ord % 3 = 0 THEN 'd' END"), ("bom:layer:index", ODD_INDEX), ("bom:cpe:10", "'c10'"), ("bom:cpe:2", "'c2'"), ("bom:cpe:1", "'c1'"), ("bom:cpe:x", "name"), ("a", "'1'"), ("bom:cpes", "'x'"), ("layer:index", "cast(ord as string)")]
    props = F.map_from_entries(F.filter(F.array(*[F.expr(f"CASE WHEN {v} IS NOT NULL THEN struct('{k}' AS key, {v} AS value) END") for k, v in pairs]), lambda e: e.isNotNull()))
    h = c.select("bom_ref", typed.hydrated(props).alias("h"))
    return h.select("bom_ref", "h.origin", F.coalesce(F.concat_ws("|", "h.layer.digest", "h.layer.index", "h.layer.line", "h.layer.added_by"), F.lit("")).alias("layer"), F.array_join("h.cpes", ";").alias("cpes"), F.array_join(F.transform(F.array_sort(F.map_entries("h.props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("props"))


STAMPS = "CASE WHEN ord % 9 = 0 THEN 'unknown' ELSE 'app' END AS origin, CASE WHEN ord % 13 = 0 THEN 'untracked-scan' ELSE 'package' END AS method, CASE WHEN ord % 14 = 0 THEN 'binary' ELSE '' END AS category, CASE ord % 5 WHEN 0 THEN 'low' WHEN 1 THEN '0.65' WHEN 2 THEN '0.70' WHEN 3 THEN 'odd' ELSE '' END AS confidence"
NICK = "CASE WHEN ord % 10 = 0 THEN concat(name, chr(34), chr(92)) ELSE name END"
SHOWN = f"(SELECT *, concat(chr(34), replace(replace(CASE WHEN version <> '' THEN concat(nick, '@', version) ELSE nick END, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(34)) AS own, CASE WHEN ord % 4 > 0 THEN concat('[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":\"opt/', name, '\"}}}}}}]') ELSE concat('[{{\"logicalLocations\":[{{\"name\":\"', bom_ref, '\",\"kind\":\"package\"}}]}}]') END AS places FROM (SELECT *, {NICK} AS nick, {SBOM} AS sbom_id, {STAMPS} FROM {C}))"
RESULTS = f"(SELECT sbom_id, ord, '001' AS rule, 'warning' AS level, concat('Untracked ', CASE WHEN category <> '' THEN category ELSE 'component' END, ' ', own, CASE WHEN ord % 4 > 0 THEN concat(' found at /opt/', name) ELSE '' END, '.') AS message, places FROM {SHOWN} WHERE method = 'untracked-scan' OR category <> '' UNION ALL SELECT sbom_id, ord, '002', 'note', concat('Component ', own, ' has Origin=unknown.'), places FROM {SHOWN} WHERE origin = 'unknown' UNION ALL SELECT sbom_id, ord, '003', 'note', concat('Component ', own, ' (PURL ', chr(34), purl, chr(34), ') has no CPE.'), places FROM {SHOWN} WHERE purl <> '' AND cpe = '' UNION ALL SELECT sbom_id, ord, '004', 'note', concat('Component ', own, ' has a low-confidence CPE (heuristic).'), places FROM {SHOWN} WHERE confidence IN ('low', '0.65'))"


@query(f"SELECT d.sbom_id, count(rule) AS results, sha256(coalesce(string_agg(concat('{{\"ruleId\":\"', rule, '\",\"level\":\"', level, '\",\"message\":{{\"text\":', to_json(message), '}},\"locations\":', places, '}}'), ',' ORDER BY rule, message, ord) FILTER (WHERE rule IS NOT NULL), 'null')) AS sha256 FROM (SELECT DISTINCT sbom_id FROM {SHOWN} UNION ALL SELECT 'bom-none') d LEFT JOIN {RESULTS} r ON r.sbom_id = d.sbom_id GROUP BY 1")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF documents: the number of their results, and the digest of their list; one has none."""
    stamps = [x.strip() for x in re.findall(r"CASE .*? END AS \w+", STAMPS)]
    c = view(spark, sf_dir, "components").selectExpr("*", *stamps, f"{SBOM} AS sbom_id").withColumn("name", F.expr(NICK))
    c = c.withColumn("places", F.when(F.col("n_locations") > 0, F.array(F.concat(F.lit("/opt/"), F.regexp_replace("name", '["\\\\]', "")))))
    documents = c.select("sbom_id").distinct().unionByName(spark.range(1).selectExpr("'bom-none' AS sbom_id"))
    texts = writers.assembled(writers.sarif_json(documents, c))
    runs = F.get_json_object("text", "$.runs[0].results")
    body = F.regexp_extract("text", r'(?s)"results":\[(.*)\]\}\]\}$', 1)
    return texts.select("sbom_id", F.coalesce(F.json_array_length(runs), F.lit(0)).cast("long").alias("results"), F.sha2(F.encode(F.when(body != "", body).otherwise(F.regexp_extract("text", '"results":(null)', 1)), "UTF-8"), 256).alias("sha256"))
