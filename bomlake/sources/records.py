"""Whole documents as records: every field that CycloneDX JSON and SPDX JSON share with the component model.

A record is a component: sbom_id, place (its way down the tree, like /00000000/00000002), and the columns of RECORD. Absent texts are
'', absent lists empty. Edges keep their order in the document as `ord`. Null or broken documents have no
rows, an empty table has none. Only the columns sbom_id, format and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import identifiers as I
from bomlake.operators import properties, typed
from bomlake.plans.tables import cut, kept
from bomlake.sources.documents import related

#: Component types that are read as such (fixed values); others are unknown.
TYPES = ("application", "framework", "library", "container", "operating-system", "device", "firmware", "file", "platform")
HASHES, LICENCES, EVIDENCE = "array<struct<alg:string,value:string>>", "array<struct<id:string,name:string,expression:string,url:string>>", "struct<method:string,confidence:float,locations:array<string>>"
RECORD = {
    **dict.fromkeys(("bom_ref", "ctype", "grp", "name", "version", "description", "scope", "purl", "author", "publisher", "copyright", "supplier"), "string"),
    "cpes": "array<string>", "hashes": HASHES, "licences": LICENCES, "evidence": EVIDENCE, "props": "map<string,string>", "origin": "string", "layer": typed.LAYER,
}
PROPERTIES = "array<struct<name:string,value:string>>"
CYCLONEDX = (
    "struct<`bom-ref`:string,type:string,group:string,name:string,version:string,description:string,scope:string,purl:string,author:string,publisher:string,copyright:string,cpe:string,supplier:struct<name:string>,"
    "hashes:array<struct<alg:string,content:string>>,licenses:array<struct<expression:string,license:struct<id:string,name:string,url:string>>>,"
    f"evidence:struct<identity:array<struct<field:string,confidence:float>>,occurrences:array<struct<location:string>>>,properties:{PROPERTIES},components:string>"
)
TOOLS = "struct<components:array<struct<name:string,version:string,group:string,supplier:struct<name:string>>>,tools:array<struct<vendor:string,name:string,version:string>>>"


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def listed(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def last_of(pairs: Column) -> Column:
    """(name, value) entries as a map; of equal names the last stays."""
    pairs = F.filter(listed(pairs, PROPERTIES), lambda p: p["name"].isNotNull())
    entry = lambda p: F.struct(p["name"].alias("key"), text(p["value"]).alias("value"))
    return properties.once(pairs, lambda named: F.map_from_entries(F.transform(properties.last_of(named, "name"), entry)))


def licence(id: Column, name: Column, expression: Column, url: Column) -> Column:
    return F.struct(text(id).alias("id"), text(name).alias("name"), text(expression).alias("expression"), text(url).alias("url"))


def of_cyclonedx(c: Column) -> dict[str, Column]:
    """RECORD columns of a parsed component; evidence is that of its first identity."""
    plain = {"bom_ref": "bom-ref", "grp": "group", **{x: x for x in ("name", "version", "description", "scope", "purl", "author", "publisher", "copyright")}}
    out = {k: text(c[v]) for k, v in plain.items()}
    out["ctype"] = F.when(c["type"].isin(*TYPES), c["type"]).otherwise("unknown")
    out["supplier"] = text(c["supplier"]["name"])
    out["hashes"] = F.transform(listed(c["hashes"], "array<struct<alg:string,content:string>>"), lambda h: F.struct(I.hash_algorithm(text(h["alg"])).alias("alg"), text(h["content"]).alias("value")))
    none = F.lit(None).cast("string")
    choice = F.transform(c["licenses"], lambda x: F.when(text(x["expression"]) != "", licence(none, none, x["expression"], none)).otherwise(licence(x["license"]["id"], x["license"]["name"], none, x["license"]["url"])))
    out["licences"] = listed(F.filter(choice, lambda x: (x["expression"] != "") | (x["id"] != "") | (x["name"] != "") | (x["url"] != "")), LICENCES)
    first = F.get(c["evidence"]["identity"], F.lit(0))
    places = F.filter(F.transform(listed(c["evidence"]["occurrences"], "array<struct<location:string>>"), lambda o: text(o["location"])), lambda p: p != "")
    method, confidence = text(first["field"]), F.coalesce(first["confidence"], F.lit(0.0).cast("float"))
    out["evidence"] = properties.once(places, lambda p: F.when((method != "") | (confidence != 0) | (F.size(p) > 0), F.struct(method.alias("method"), confidence.alias("confidence"), p.alias("locations")))).cast(EVIDENCE)
    out["h"] = typed.hydrated(last_of(c["properties"]))
    return out


def settled(rows: DataFrame, own: dict[str, Column], *keys: str) -> DataFrame:
    """Keys and RECORD columns, typed fields taken from the property map `h`."""
    rows = rows.select(*keys, *[v.alias(k) for k, v in own.items()])
    cpes = F.concat(F.col("cpes"), F.col("h.cpes"))
    return rows.withColumns({"cpes": cpes, "props": F.col("h.props"), "origin": F.col("h.origin"), "layer": F.col("h.layer")}).select(*keys, *RECORD)


def cyclonedx_records(documents: DataFrame) -> DataFrame:
    """Components of every depth. Each level is parsed once, and its children's texts are cut to a table."""
    level = documents.filter("format = 'cyclonedx-json'").select("sbom_id", F.get_json_object("text", "$.components").alias("json"), F.lit("").alias("above"))
    out = None
    while True:
        rows = level.select("sbom_id", "above", F.posexplode(F.from_json("json", f"array<{CYCLONEDX}>")).alias("pos", "c")).filter("c IS NOT NULL")
        rows = rows.withColumn("place", F.concat("above", F.format_string("/%08d", "pos")))
        own = of_cyclonedx(F.col("c"))
        own["cpes"] = F.when(text(F.col("c.cpe")) != "", F.array("c.cpe")).otherwise(F.array().cast("array<string>"))
        part = settled(rows, own, "sbom_id", "place")
        out = part if out is None else out.unionByName(part)
        level = cut(rows.filter("c.components IS NOT NULL").select("sbom_id", F.col("c.components").alias("json"), F.col("place").alias("above")))
        if level.isEmpty():
            return out


def cyclonedx_relations(documents: DataFrame) -> DataFrame:
    """sbom_id, ord, src, dst, rel: what an entry depends on, then what it provides, in the document's order."""
    kind = "array<struct<ref:string,dependsOn:array<string>,provides:array<string>>>"
    deps = documents.filter("format = 'cyclonedx-json'").select("sbom_id", F.posexplode(F.from_json(F.get_json_object("text", "$.dependencies"), kind)).alias("i", "d"))
    targets = lambda field, rel: F.transform(listed(F.col(f"d.{field}"), "array<string>"), lambda x: F.struct(x.alias("dst"), F.lit(rel).alias("rel")))
    both = F.concat(targets("dependsOn", "depends-on"), targets("provides", "provides"))
    rows = deps.select("sbom_id", "i", text(F.col("d.ref")).alias("src"), F.posexplode(both).alias("j", "e"))
    return rows.select("sbom_id", (F.col("i") * F.lit(1 << 32) + F.col("j")).alias("ord"), "src", text(F.col("e.dst")).alias("dst"), "e.rel")


def cyclonedx_metadata(documents: DataFrame) -> DataFrame:
    """sbom_id, created (timestamp or null), authors, tools (vendor, name, version), name of the root component, props."""
    kind = f"struct<timestamp:string,authors:array<struct<name:string>>,tools:string,component:struct<name:string>,properties:{PROPERTIES}>"
    m = documents.filter("format = 'cyclonedx-json'").select("sbom_id", F.from_json(F.get_json_object("text", "$.metadata"), kind).alias("m"))
    # tools are an object of components, or a list in older documents
    t = m.withColumns({"t": F.from_json("m.tools", TOOLS), "old": F.from_json(F.when(F.col("m.tools").startswith("["), F.col("m.tools")), "array<struct<vendor:string,name:string,version:string>>")})
    tool = lambda vendor, x: F.struct(text(vendor).alias("vendor"), text(x["name"]).alias("name"), text(x["version"]).alias("version"))
    none = "array<struct<vendor:string,name:string,version:string>>"
    tools = F.concat(listed(F.transform("t.components", lambda c: tool(F.when(c["supplier"].isNotNull(), c["supplier"]["name"]).otherwise(c["group"]), c)), none), listed(F.transform("t.tools", lambda x: tool(x["vendor"], x)), none), listed(F.transform("old", lambda x: tool(x["vendor"], x)), none))
    authors = F.filter(F.transform(listed(F.col("m.authors"), "array<struct<name:string>>"), lambda a: F.trim(text(a["name"]))), lambda a: a != "")
    return t.select("sbom_id", properties.moment(F.col("m.timestamp")).alias("created"), authors.alias("authors"), tools.alias("tools"), text(F.col("m.component.name")).alias("name"), last_of(F.col("m.properties")).alias("props"))


def tool_of(creator: Column) -> Column:
    """struct(vendor, name, version) of `vendor name-version`: the last dash starts the version, the last space before it the name."""
    dash = creator.rlike("(?s)^.+-[^-]*$")
    head = F.when(dash, F.regexp_extract(creator, "(?s)^(.+)-[^-]*$", 1)).otherwise(creator)
    spaced = head.rlike("(?s)^.+ [^ ]*$")
    return F.struct(
        F.when(spaced, F.regexp_extract(head, "(?s)^(.+) [^ ]*$", 1)).otherwise("").alias("vendor"),
        F.when(spaced, F.regexp_extract(head, "(?s)^.+ ([^ ]*)$", 1)).otherwise(head).alias("name"),
        F.when(dash, F.regexp_extract(creator, "(?s)^.+-([^-]*)$", 1)).otherwise("").alias("version"),
    )


SPDX_PACKAGE = "struct<SPDXID:string,name:string,versionInfo:string,supplier:string,description:string,copyrightText:string,licenseConcluded:string,licenseDeclared:string,checksums:array<struct<algorithm:string,checksumValue:string>>,externalRefs:array<struct<referenceType:string,referenceLocator:string>>,annotations:array<struct<comment:string>>>"


def spdx_ref(id: Column) -> Column:
    return F.regexp_replace(text(id), "^SPDXRef-", "")


def spdx_packages(documents: DataFrame) -> DataFrame:
    """Packages of SPDX JSON as records without a place, in order of `ord`."""
    rows = documents.filter("format = 'spdx-json'").select("sbom_id", F.posexplode(F.from_json(F.get_json_object("text", "$.packages"), f"array<{SPDX_PACKAGE}>")).alias("ord", "p")).filter("p IS NOT NULL")
    p = F.col("p")
    known = lambda x: F.when(~text(x).isin("", "NOASSERTION"), x)
    expression = F.coalesce(known(p["licenseConcluded"]), known(p["licenseDeclared"]))
    none, refs = F.lit(None).cast("string"), listed(p["externalRefs"], "array<struct<referenceType:string,referenceLocator:string>>")
    of_kind = lambda k: F.transform(F.filter(refs, lambda r: r["referenceType"] == k), lambda r: text(r["referenceLocator"]))
    own = {
        "bom_ref": spdx_ref(p["SPDXID"]), "ctype": F.lit("library"), "name": text(p["name"]), "version": text(p["versionInfo"]), "description": text(p["description"]), "copyright": text(p["copyrightText"]),
        **{x: F.lit("") for x in ("grp", "scope", "author", "publisher")},
        "supplier": F.regexp_replace(F.when(text(p["supplier"]) == "NOASSERTION", "").otherwise(text(p["supplier"])), "^(Organization|Person): *", ""),
        "purl": text(F.try_element_at(of_kind("purl"), F.lit(-1))), "cpes": of_kind("cpe23Type"),
        "hashes": F.transform(listed(p["checksums"], "array<struct<algorithm:string,checksumValue:string>>"), lambda h: F.struct(I.hash_algorithm(text(h["algorithm"])).alias("alg"), text(h["checksumValue"]).alias("value"))),
        "licences": F.when(expression.isNotNull(), F.array(licence(none, none, expression, none))).otherwise(F.array().cast(LICENCES)),
        "evidence": F.lit(None).cast(EVIDENCE), "h": typed.hydrated(properties.from_annotations(F.transform(p["annotations"], lambda a: a["comment"])), numbered=False),
    }
    return settled(rows, own, "sbom_id", "ord")


def spdx_relations(documents: DataFrame) -> DataFrame:
    """sbom_id, ord, src, dst, rel of SPDX JSON; what a document describes is left out."""
    kind = "array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>"
    rows = documents.filter("format = 'spdx-json'").select("sbom_id", F.posexplode(F.from_json(F.get_json_object("text", "$.relationships"), kind)).alias("ord", "r"))
    named = rows.select("sbom_id", F.struct("ord", spdx_ref(F.col("r.spdxElementId")).alias("src")).alias("src"), F.col("r.relationshipType").alias("kind"), spdx_ref(F.col("r.relatedSpdxElement")).alias("dst"))
    return related(named).select("sbom_id", F.col("src.ord").alias("ord"), F.col("src.src").alias("src"), "dst", "rel")


def nested(packages: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages of (sbom_id, ord, bom_ref, ...) put where `contains` relations of two known packages say, and the other relations.

    A relation puts its package, with what relations before it have put inside, under its parent; a package under two parents is
    there twice, and one that is contained is not at the top. Of packages with one reference the last is meant. One join a
    level; places of a branch come from ever earlier relations, so a cycle ends (and has no top).
    """
    packages = kept(packages)  # three uses
    known = packages.groupBy("sbom_id", "bom_ref").agg(F.max("ord").alias("last"))
    inside = relations.filter("rel = 'contains'")
    for end in ("src", "dst"):
        inside = inside.join(known.select("sbom_id", F.col("bom_ref").alias(end), F.col("last").alias(f"{end}_at")), ["sbom_id", end], "left")
    inside = cut(inside)
    other = relations.filter("rel <> 'contains'").unionByName(inside.filter("src_at IS NULL OR dst_at IS NULL").select(*relations.columns))
    steps = inside.filter("src_at IS NOT NULL AND dst_at IS NOT NULL").select("sbom_id", F.col("ord").alias("step"), F.col("src").alias("up"), "dst", "dst_at")
    top = packages.join(steps.select("sbom_id", F.col("dst").alias("bom_ref")).distinct(), ["sbom_id", "bom_ref"], "left_anti")
    level = cut(top.select("sbom_id", "ord", "bom_ref", F.format_string("/%08d", "ord").alias("place"), F.lit((1 << 62)).cast("long").alias("before")))
    places = level
    while not level.isEmpty():
        below = level.select("sbom_id", F.col("bom_ref").alias("up"), "place", "before").join(steps, ["sbom_id", "up"]).filter("step < before")
        level = cut(below.select("sbom_id", F.col("dst_at").alias("ord"), F.col("dst").alias("bom_ref"), F.concat("place", F.format_string("/%08d", "step")).alias("place"), F.col("step").cast("long").alias("before")))
        places = places.unionByName(level)
    return packages.join(places.select("sbom_id", "ord", "place"), ["sbom_id", "ord"]).drop("ord"), other


def spdx_metadata(documents: DataFrame) -> DataFrame:
    """The same columns as cyclonedx_metadata(): tools and authors from the creators, props from annotations."""
    kind = "struct<created:string,creators:array<string>>"
    m = documents.filter("format = 'spdx-json'").select("sbom_id", F.from_json(F.get_json_object("text", "$.creationInfo"), kind).alias("m"), F.from_json(F.get_json_object("text", "$.annotations"), "array<struct<comment:string>>").alias("a"), F.get_json_object("text", "$.name").alias("name"))
    made = listed(F.col("m.creators"), "array<string>")
    tools = F.transform(F.filter(made, lambda c: c.startswith("Tool:")), lambda c: tool_of(F.trim(F.regexp_replace(c, "^Tool:", ""))))
    authors = F.transform(F.filter(made, lambda c: c.rlike("^(Person|Organization):")), lambda c: F.trim(F.regexp_replace(c, "^(Person|Organization):", "")))
    return m.select("sbom_id", properties.moment(F.col("m.created")).alias("created"), authors.alias("authors"), tools.alias("tools"), text(F.col("name")).alias("name"), properties.from_annotations(F.transform("a", lambda x: x["comment"])).alias("props"))
