"""Whole CycloneDX, SPDX and SARIF documents, written as ordered fragments.

A document is its fragments (sbom_id, part, key, text) one after the other in order of part and key. A component gives one fragment, or, around
its children, an opening and a closing one; an edge gives one of its own. So neither a large document, a parent with
many children nor a source with many edges is ever gathered in one row: ordered() sorts the fragments over many tasks.
assembled() makes texts of documents up to a size, and raises an error beyond it.

Records are those of sources.records; their places form trees, every parent being there, and the record of place '' is the document's root
component. Absent texts are '', nulls count as absent; a table without rows gives documents without that section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomlake import __version__
from bomlake.functions import paths as P
from bomlake.operators import properties, sarif, typed
from bomlake.sources.documents import MAX_BYTES

#: Versions of the formats that are written (fixed values).
CYCLONEDX_VERSION, SPDX_VERSION, LICENCE_LIST, DATA_LICENCE = "1.6", "SPDX-2.3", "3.23", "CC0-1.0"
#: Hash names of CycloneDX, and those that SPDX has (fixed values).
CYCLONEDX_HASHES = {"md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512", "blake2b-256": "BLAKE2b-256", "blake2b-512": "BLAKE2b-512", "blake3": "BLAKE3", "swhid": "SWHID"}
SPDX_HASHES = {"md5": "MD5", "sha1": "SHA1", "sha256": "SHA256", "sha384": "SHA384", "sha512": "SHA512"}
#: Relations of SPDX by those of edges; others aren't written (fixed values).
SPDX_RELATIONS = {"depends-on": "DEPENDS_ON", "provides": "DEPENDENCY_OF", "contains": "CONTAINS"}
TOOL = "bomlake"
NAMESPACE = "https://spdx.org/spdxdocs/"
#: Sorts after every place below its own.
LAST = "/~"


def some(value: Column) -> Column:
    return F.when(value != "", value)


def quoted(value: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def named(value: Column, names: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), other)


def filled(array: Column) -> Column:
    """An array, or null where it has nothing."""
    return properties.once(array, lambda a: F.when(F.size(a) > 0, a))


def property_list(props: Column) -> Column:
    return filled(F.transform(F.array_sort(F.map_entries(properties.held(props))), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))))


def component_json(c: DataFrame) -> Column:
    """A record as CycloneDX JSON without its children."""
    evidence = c["evidence"]
    stated = (evidence["method"] != "") | (evidence["confidence"] != 0)
    places = F.transform(evidence["locations"], lambda p: F.struct(p.alias("location")))
    licence = lambda x: F.when(x["expression"] != "", F.struct(x["expression"].alias("expression"), F.lit(None).cast("struct<id:string,name:string,url:string>").alias("license"))).otherwise(F.struct(F.lit(None).cast("string").alias("expression"), F.struct(some(x["id"]).alias("id"), some(x["name"]).alias("name"), some(x["url"]).alias("url")).alias("license")))
    told = F.filter(c["licences"], lambda x: (x["expression"] != "") | (x["id"] != "") | (x["name"] != "") | (x["url"] != ""))
    return F.to_json(
        F.struct(
            some(c["bom_ref"]).alias("bom-ref"), c["ctype"].alias("type"), some(c["grp"]).alias("group"), c["name"].alias("name"), *[some(c[x]).alias(x) for x in ("version", "description", "scope", "publisher", "author", "purl")],
            some(F.get(c["cpes"], F.lit(0))).alias("cpe"), F.when(c["supplier"] != "", F.struct(c["supplier"].alias("name"))).alias("supplier"), some(c["copyright"]).alias("copyright"),
            filled(F.transform(c["hashes"], lambda h: F.struct(named(h["alg"], CYCLONEDX_HASHES, h["alg"]).alias("alg"), h["value"].alias("content")))).alias("hashes"),
            filled(F.transform(told, licence)).alias("licenses"),
            F.when(stated | (F.size(places) > 0), F.struct(F.when(stated, F.array(F.struct(evidence["method"].alias("field"), evidence["confidence"].alias("confidence")))).alias("identity"), filled(places).alias("occurrences"))).alias("evidence"),
            property_list(typed.dehydrated(c["props"], c["origin"], c["layer"], c["cpes"])).alias("properties"),
        )
    )


def section(rows: DataFrame, part: int, name: str) -> DataFrame:
    """(sbom_id, key, text) -> fragments of a list: the first of a document opens it, the others follow a comma, a last one closes it."""
    first = rows.groupBy("sbom_id").agg(F.min("key").alias("key")).withColumn("opens", F.lit(True))
    begun = rows.join(first, ["sbom_id", "key"], "left")
    mark = F.when(F.col("opens"), f',"{name}":[').otherwise(",")
    body = begun.select("sbom_id", F.lit(part).alias("part"), "key", F.concat(mark, "text").alias("text"))
    return body.unionByName(first.select("sbom_id", F.lit(part).alias("part"), F.lit("~").alias("key"), F.lit("]").alias("text")))


def nested(records: DataFrame, part: int, name: str) -> DataFrame:
    """Fragments of the components, children within their parents."""
    rows = records.filter("place <> ''").select("sbom_id", "place", component_json(records).alias("json"))
    firsts = rows.groupBy("sbom_id", P.parent(F.col("place")).alias("up")).agg(F.min("place").alias("first"))
    own = rows.join(firsts.select("sbom_id", F.col("up").alias("place"), F.lit(True).alias("has")), ["sbom_id", "place"], "left")
    own = own.join(firsts.select("sbom_id", F.col("first").alias("place"), (F.col("up") == "").alias("top")), ["sbom_id", "place"], "left")
    mark = F.when(F.col("top"), f',"{name}":[').when(F.col("top").isNull(), ",").otherwise("")
    opened = F.when(F.col("has"), F.concat(F.left("json", F.length("json") - 1), F.lit(',"components":['))).otherwise(F.col("json"))
    body = F.array(F.struct(F.col("place").alias("key"), F.concat(mark, opened).alias("text")), F.when(F.col("has"), F.struct(F.concat("place", F.lit(LAST)).alias("key"), F.lit("]}").alias("text"))))
    closed = firsts.filter("up = ''").select("sbom_id", F.lit(part).alias("part"), F.lit("~").alias("key"), F.lit("]").alias("text"))
    return own.select("sbom_id", F.lit(part).alias("part"), F.explode(F.filter(body, lambda x: x.isNotNull())).alias("f")).select("sbom_id", "part", "f.key", "f.text").unionByName(closed)


def dependencies(edges: DataFrame, part: int) -> DataFrame:
    """Fragments of the dependencies: sources as they are first seen, each with its targets in order, also if none are written."""
    at = lambda c: F.format_string("%020d", c)
    of = lambda rel: F.min(F.when(F.col("rel") == rel, F.col("ord")))
    sources = edges.groupBy("sbom_id", "src").agg(F.min("ord").alias("first"), of("depends-on").alias("needs"), of("provides").alias("gives"))
    begin = sources.groupBy("sbom_id").agg(F.min("first").alias("first")).withColumn("opens", F.lit(True))
    mark = F.when(F.col("opens"), ',"dependencies":[').otherwise(",")
    frame = F.array(
        F.struct(F.lit("/0").alias("key"), F.concat(mark, F.lit('{"ref":'), quoted(F.col("src"))).alias("text")),
        *[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.lit("]").alias("text"))) for c, k in (("needs", "/1~"), ("gives", "/2~"))],
        F.struct(F.lit("/3").alias("key"), F.lit("}").alias("text")),
    )
    around = sources.join(begin, ["sbom_id", "first"], "left").select("sbom_id", "first", F.explode(F.filter(frame, lambda x: x.isNotNull())).alias("f")).select("sbom_id", F.concat(at("first"), "f.key").alias("key"), "f.text")
    written = edges.filter("rel IN ('depends-on', 'provides')").join(sources, ["sbom_id", "src"])
    needs = F.col("rel") == "depends-on"
    opens = F.when(F.col("ord") == F.when(needs, F.col("needs")).otherwise(F.col("gives")), F.when(needs, ',"dependsOn":[').otherwise(',"provides":[')).otherwise(",")
    targets = written.select("sbom_id", F.concat(at("first"), F.when(needs, "/1/").otherwise("/2/"), at("ord")).alias("key"), F.concat(opens, quoted(F.col("dst"))).alias("text"))
    closed = begin.select("sbom_id", F.lit("~").alias("key"), F.lit("]").alias("text"))
    return around.unionByName(targets).unionByName(closed).withColumn("part", F.lit(part)).select("sbom_id", "part", "key", "text")


def one(documents: DataFrame, part: int, text: Column) -> DataFrame:
    return documents.select("sbom_id", F.lit(part).alias("part"), F.lit("").alias("key"), text.alias("text"))


def cyclonedx(documents: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """Fragments of CycloneDX JSON. Documents: sbom_id, created, authors, tools, props (of the metadata), own_props (of the document)."""
    root = records.filter("place = ''").select("sbom_id", component_json(records).alias("root"))
    d = documents.join(root, "sbom_id", "left")
    tool = lambda t: F.struct(F.lit("application").alias("type"), t["name"].alias("name"), some(t["version"]).alias("version"), F.when(t["vendor"] != "", F.struct(t["vendor"].alias("name"))).alias("supplier"))
    tools, authors = filled(F.transform("tools", tool)), filled(F.transform("authors", lambda a: F.struct(a.alias("name"))))
    listed = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), F.to_json(value)))
    parts = [
        F.when(F.col("created").isNotNull(), F.concat(F.lit('"timestamp":"'), F.date_format(F.to_utc_timestamp("created", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))),
        listed("authors", authors), F.when(tools.isNotNull(), F.concat(F.lit('"tools":'), F.to_json(F.struct(tools.alias("components"))))),
        F.concat(F.lit('"component":'), F.col("root")), listed("properties", property_list(F.col("props"))),
    ]
    metadata = F.concat_ws(",", *parts)
    own = property_list(F.col("own_props"))
    out = one(d, 0, F.lit(f'{{"bomFormat":"CycloneDX","specVersion":"{CYCLONEDX_VERSION}","version":1')).unionByName(one(d, 1, F.when(metadata != "", F.concat(F.lit(',"metadata":{'), metadata, F.lit("}"))).otherwise("")))
    out = out.unionByName(nested(records, 2, "components")).unionByName(dependencies(edges, 3))
    return out.unionByName(one(d, 4, F.concat(F.when(own.isNotNull(), F.concat(F.lit(',"properties":'), F.to_json(own))).otherwise(""), F.lit("}"))))


def spdx_id(value: Column) -> Column:
    return F.concat(F.lit("SPDXRef-"), F.when(value == "", "Package").otherwise(F.regexp_replace(value, "[^A-Za-z0-9.-]", "-")))


def package_id(c: DataFrame) -> Column:
    return spdx_id(F.when(c["bom_ref"] != "", c["bom_ref"]).otherwise(F.concat_ws("-", c["name"], c["version"])))


def notes(props: Column, created: str) -> Column:
    """Properties as annotations, in order of their keys."""
    return filled(F.transform(properties.to_annotations(props), lambda c: F.struct(F.lit(created).alias("annotationDate"), F.lit("OTHER").alias("annotationType"), F.lit(f"Tool: {TOOL}-{__version__}").alias("annotator"), c.alias("comment"))))


def package_json(c: DataFrame, created: str) -> Column:
    """A record as an SPDX package: licences joined by AND, hashes that SPDX doesn't know left out."""
    licences = F.array_join(F.filter(F.transform(c["licences"], lambda x: F.coalesce(some(x["expression"]), some(x["id"]), some(x["name"]))), lambda x: x.isNotNull()), " AND ")
    sums = F.filter(F.transform(c["hashes"], lambda h: F.struct(named(h["alg"], SPDX_HASHES, F.lit(None)).alias("algorithm"), h["value"].alias("checksumValue"))), lambda h: h["algorithm"].isNotNull())
    ref = lambda category, kind, value: F.struct(F.lit(category).alias("referenceCategory"), F.lit(kind).alias("referenceType"), value.alias("referenceLocator"))
    refs = F.concat(F.filter(F.array(F.when(c["purl"] != "", ref("PACKAGE-MANAGER", "purl", c["purl"]))), lambda r: r.isNotNull()), F.transform(c["cpes"], lambda x: ref("SECURITY", "cpe23Type", x)))
    return properties.once(licences, lambda stated: F.to_json(
        F.struct(
            package_id(c).alias("SPDXID"), c["name"].alias("name"), some(c["version"]).alias("versionInfo"), F.when(c["supplier"] != "", F.concat(F.lit("Organization: "), c["supplier"])).alias("supplier"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
            filled(sums).alias("checksums"), some(stated).alias("licenseConcluded"), some(stated).alias("licenseDeclared"), some(c["copyright"]).alias("copyrightText"), some(c["description"]).alias("description"),
            filled(refs).alias("externalRefs"), notes(typed.dehydrated(c["props"], c["origin"], c["layer"]), created).alias("annotations"),
        )
    ))


def spdx(documents: DataFrame, records: DataFrame, edges: DataFrame, created: str) -> DataFrame:
    """Fragments of SPDX JSON; `created` is the time that it states. Documents: sbom_id, own_props.

    Parents come before their children, and a containment after those within it; then what the document describes, and edges of known relations.
    """
    rows = records.filter("place <> ''")
    root = records.filter("place = '' AND name <> ''").groupBy("sbom_id").agg(F.min("name").alias("root"))
    d = documents.join(root, "sbom_id", "left").withColumn("root", F.coalesce("root", F.lit(f"{TOOL}-sbom")))
    head = F.to_json(
        F.struct(
            F.lit(SPDX_VERSION).alias("spdxVersion"), F.lit(DATA_LICENCE).alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("root").alias("name"), F.concat(F.lit(f"{NAMESPACE}{TOOL}/"), "root").alias("documentNamespace"),
            F.struct(F.lit(LICENCE_LIST).alias("licenseListVersion"), F.array(F.lit(f"Tool: {TOOL}-{__version__}")).alias("creators"), F.lit(created).alias("created")).alias("creationInfo"), notes(F.col("own_props"), created).alias("annotations"),
        )
    )
    relation = lambda a, kind, b: F.to_json(F.struct(a.alias("spdxElementId"), kind.alias("relationshipType"), b.alias("relatedSpdxElement")))
    ids = rows.select("sbom_id", "place", package_id(rows).alias("id"))
    up = ids.select("sbom_id", F.col("place").alias("up"), F.col("id").alias("up_id"))
    inside = ids.withColumn("up", P.parent(F.col("place"))).join(up, ["sbom_id", "up"]).select("sbom_id", F.concat(F.lit("0"), "place", F.lit(LAST)).alias("key"), relation(F.col("up_id"), F.lit("CONTAINS"), F.col("id")).alias("text"))
    described = ids.filter(P.parent(F.col("place")) == "").select("sbom_id", F.concat(F.lit("1"), "place").alias("key"), relation(F.lit("SPDXRef-DOCUMENT"), F.lit("DESCRIBES"), F.col("id")).alias("text"))
    kind = named(F.col("rel"), SPDX_RELATIONS, F.lit(None))
    others = edges.filter(kind.isNotNull()).select("sbom_id", F.concat(F.lit("2"), F.format_string("%020d", "ord")).alias("key"), relation(spdx_id(F.col("src")), kind, spdx_id(F.col("dst"))).alias("text"))
    packages = section(rows.select("sbom_id", F.col("place").alias("key"), package_json(rows, created).alias("text")), 1, "packages")
    return one(d, 0, F.left(head, F.length(head) - 1)).unionByName(packages).unionByName(section(inside.unionByName(described).unionByName(others), 2, "relationships")).unionByName(one(d, 3, F.lit("}")))


def sarif_json(documents: DataFrame, components: DataFrame) -> DataFrame:
    """Fragments of SARIF: results in order of rule and message. Components: those of operators.sarif with sbom_id and ord; without results the list is null."""
    rules = F.array(*[F.struct(F.lit(rule).alias("id"), F.lit(name).alias("name"), F.struct(F.lit(text).alias("text")).alias("shortDescription"), F.struct(F.lit(category).alias("category")).alias("properties")) for rule, name, text, category in sarif.RULES])
    physical = lambda p: F.struct(F.struct(F.struct(p.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    logical = F.array(F.struct(F.array(F.struct(F.col("bom_ref").alias("name"), F.lit("package").alias("kind"))).alias("logicalLocations")))
    found = sarif.found(components, "sbom_id", "ord")
    where = F.when(F.size("paths") > 0, F.to_json(F.transform("paths", physical))).when(F.col("bom_ref") != "", F.to_json(logical))
    own = F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message")))
    rows = found.select("sbom_id", F.concat_ws("\u0001", "rule", "message", F.format_string("%020d", "ord")).alias("key"), F.when(where.isNotNull(), F.concat(F.left(own, F.length(own) - 1), F.lit(',"locations":'), where, F.lit("}"))).otherwise(own).alias("text"))
    has = rows.groupBy("sbom_id").agg(F.lit(True).alias("has"))
    d = documents.select("sbom_id").join(has, "sbom_id", "left")
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), F.to_json(F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version"), rules.alias("rules"))), F.lit("}"))
    return one(d, 0, head).unionByName(section(rows, 1, "results")).unionByName(one(d, 2, F.when(F.col("has"), "}]}").otherwise(',"results":null}]}')))


def ordered(fragments: DataFrame) -> DataFrame:
    """Fragments in order over many tasks: written as text, the files of one document after the other are the document."""
    n = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fragments.repartitionByRange(n, "sbom_id", "part", "key").sortWithinPartitions("sbom_id", "part", "key")


def assembled(fragments: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """(sbom_id, text) of documents up to `limit` bytes, the size up to which they are read; a larger one raises an error."""
    # fragments are made once; the window spills, and its sum is seen before any of a document's rows is collected
    sized = fragments.withColumn("bytes", F.sum(F.octet_length("text")).over(Window.partitionBy("sbom_id")))
    fits = F.when(F.col("bytes") <= limit, True).otherwise(F.raise_error(F.concat(F.lit("too large for one text: "), "sbom_id")))
    held = sized.filter(fits)
    return held.groupBy("sbom_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "text"))), lambda f: f["text"]), "").alias("text"))
