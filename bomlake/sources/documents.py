"""Bills of materials: format sniffing, CycloneDX (JSON, XML) and SPDX (JSON, tag-value) to components and edges, and back."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by what a document starts with or has at its top level; documents beyond the limit are refused.
MAX_BYTES = 256 << 20
#: Levels that are unrolled without a look whether any are left.
DEPTH = 8


def sniffed(text: Column) -> Column:
    body = F.ltrim(F.regexp_replace(text, "^﻿", ""))
    return (
        F.when(body.startswith("{") & (F.get_json_object(body, "$.bomFormat") == "CycloneDX"), "cyclonedx-json")
        .when(body.startswith("{") & F.get_json_object(body, "$.spdxVersion").isNotNull(), "spdx-json")
        .when(body.startswith("<") & body.contains("cyclonedx"), "cyclonedx-xml")
        .when(body.startswith("SPDXVersion:"), "spdx-tag-value")
        .otherwise("unknown")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: sbom_id (its path), format, text. A larger one than MAX_BYTES raises an error when it is read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("sbom_id"), F.col("value").alias("text"))
    whole = F.when(F.octet_length("text") <= MAX_BYTES, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "sbom_id")))
    return files.withColumn("text", whole).withColumn("format", sniffed(F.col("text")))


COMPONENT = "struct<`bom-ref`:string,type:string,group:string,name:string,version:string,purl:string,cpe:string,supplier:struct<name:string>,components:string>"


def cyclonedx_components(documents: DataFrame) -> DataFrame:
    """Components of every depth with parent and order; nesting is unrolled level by level."""
    level = documents.filter("format = 'cyclonedx-json'").select("sbom_id", F.get_json_object("text", "$.components").alias("json"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("place"))
    out = None
    for depth in count():
        if depth >= DEPTH and level.isEmpty():
            return out
        rows = level.select("sbom_id", "parent", "place", F.posexplode(F.from_json("json", f"array<{COMPONENT}>")).alias("pos", "c"))
        rows = rows.withColumn("place", F.concat("place", F.format_string("/%08d", "pos")))
        part = rows.select("sbom_id", "parent", "place", F.lit(depth).alias("depth"), F.col("c.bom-ref").alias("bom_ref"), F.coalesce("c.type", F.lit("unknown")).alias("ctype"), *[F.coalesce(f"c.{x}", F.lit("")).alias(y) for x, y in (("group", "grp"), ("name", "name"), ("version", "version"), ("purl", "purl"), ("cpe", "cpe"), ("supplier.name", "supplier"))])
        out = part if out is None else out.unionByName(part)
        level = rows.filter("c.components is not null").select("sbom_id", F.col("c.components").alias("json"), F.col("c.bom-ref").alias("parent"), "place")


def cyclonedx_edges(documents: DataFrame) -> DataFrame:
    kind = "array<struct<ref:string,dependsOn:array<string>>>"
    deps = documents.filter("format = 'cyclonedx-json'").select("sbom_id", F.explode(F.from_json(F.get_json_object("text", "$.dependencies"), kind)).alias("d"))
    return deps.select("sbom_id", F.col("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"), F.lit("depends-on").alias("rel"))


def spdx_components(documents: DataFrame) -> DataFrame:
    kind = "array<struct<SPDXID:string,name:string,versionInfo:string,supplier:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>"
    rows = documents.filter("format = 'spdx-json'").select("sbom_id", F.posexplode(F.from_json(F.get_json_object("text", "$.packages"), kind)).alias("ord", "p"))
    ref = lambda k: F.coalesce(F.get(F.filter("p.externalRefs", lambda r: r["referenceType"] == k), F.lit(0))["referenceLocator"], F.lit(""))
    return rows.select("sbom_id", "ord", F.col("p.SPDXID").alias("bom_ref"), F.lit("library").alias("ctype"), F.col("p.name").alias("name"), F.coalesce("p.versionInfo", F.lit("")).alias("version"), ref("purl").alias("purl"), ref("cpe23Type").alias("cpe"), F.regexp_replace(F.coalesce("p.supplier", F.lit("")), "^(Organization|Person): ", "").alias("supplier"))


def xml_kind(depth: int) -> str:
    """Components as XML nests them, down to `depth` further levels."""
    below = f",components:{xml_kind(depth - 1)}" if depth else ""
    return f"struct<component:array<struct<`_bom-ref`:string,_type:string,group:string,name:string,version:string,purl:string,cpe:string,supplier:struct<name:string>{below}>>>"


def xml_depth(documents: DataFrame) -> int:
    """Levels of components in the deepest XML document, or more."""
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"<(/?(?:[\w.-]+:)?components(?=[\s>]))(?![^>]*/>)"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, t: F.when(t.startswith("/"), F.struct((s["now"] - 1).alias("now"), s["most"].alias("most"))).otherwise(F.struct((s["now"] + 1).alias("now"), F.greatest(s["now"] + 1, s["most"]).alias("most")))
    return documents.filter("format = 'cyclonedx-xml'").agg(F.max(F.aggregate(tags, start, step)["most"])).first()[0] or 0


def cyclonedx_xml(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """sbom_id and the parsed document: components of `depth` levels, dependencies."""
    kind = f"components {xml_kind(depth - 1)}, dependencies struct<dependency:array<struct<_ref:string,dependency:array<struct<_ref:string>>>>>"
    rows = documents.filter("format = 'cyclonedx-xml'")
    return rows.select("sbom_id", F.from_xml(F.regexp_replace("text", "^\\ufeff", ""), kind, {"ignoreNamespace": "true"}).alias("d"))


def cyclonedx_xml_components(documents: DataFrame) -> DataFrame:
    """The same rows as cyclonedx_components()."""
    levels = max(1, xml_depth(documents))
    level = cyclonedx_xml(documents, levels).select("sbom_id", F.col("d.components.component").alias("own"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("place"))
    out = None
    for depth in range(levels):
        rows = level.select("sbom_id", "parent", "place", F.posexplode("own").alias("pos", "c")).withColumn("place", F.concat("place", F.format_string("/%08d", "pos")))
        part = rows.select("sbom_id", "parent", "place", F.lit(depth).alias("depth"), F.col("c._bom-ref").alias("bom_ref"), F.coalesce("c._type", F.lit("unknown")).alias("ctype"), *[F.coalesce(f"c.{x}", F.lit("")).alias(y) for x, y in (("group", "grp"), ("name", "name"), ("version", "version"), ("purl", "purl"), ("cpe", "cpe"), ("supplier.name", "supplier"))])
        out = part if out is None else out.unionByName(part)
        if depth < levels - 1:
            level = rows.select("sbom_id", F.col("c.components.component").alias("own"), F.col("c._bom-ref").alias("parent"), "place")
    return out


def cyclonedx_xml_edges(documents: DataFrame) -> DataFrame:
    deps = cyclonedx_xml(documents).select("sbom_id", F.explode("d.dependencies.dependency").alias("d"))
    return deps.select("sbom_id", F.col("d._ref").alias("src"), F.explode("d.dependency._ref").alias("dst"), F.lit("depends-on").alias("rel"))


def tag_value_components(documents: DataFrame) -> DataFrame:
    """Packages of tag-value documents: a section runs from one package's name to the next."""
    parts = F.split("text", r"(?m)^PackageName:[ \t]*")
    rows = documents.filter("format = 'spdx-tag-value'").select("sbom_id", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("ord", "s"))
    tag = lambda name: F.trim(F.regexp_extract("s", rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1))
    ref = lambda kind: F.regexp_extract("s", rf"(?m)^ExternalRef:[ \t]*\S+[ \t]+{kind}[ \t]+(\S+)", 1)
    return rows.select("sbom_id", "ord", tag("SPDXID").alias("bom_ref"), F.lit("library").alias("ctype"), F.trim(F.regexp_extract("s", r"^([^\r\n]*)", 1)).alias("name"), tag("PackageVersion").alias("version"), ref("purl").alias("purl"), ref("cpe23Type").alias("cpe"), F.regexp_replace(tag("PackageSupplier"), "^((Organization|Person): |NOASSERTION$)", "").alias("supplier"))


#: What relationships of SPDX are called here; others are unknown (fixed values).
RELATIONS = {"DEPENDS_ON": "depends-on", "DEPENDENCY_OF": "provides", "CONTAINS": "contains"}


def related(rows: DataFrame) -> DataFrame:
    """(sbom_id, src, kind, dst) -> edges; what a document describes is no edge."""
    names = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    return rows.filter("kind <> 'DESCRIBES'").select("sbom_id", "src", "dst", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("unknown")).alias("rel"))


def tag_value_edges(documents: DataFrame) -> DataFrame:
    line = r"(?m)^Relationship:[ \t]*(\S+)[ \t]+(\S+)[ \t]+(\S+)"
    rows = documents.filter("format = 'spdx-tag-value'").select("sbom_id", F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(0))).alias("r"))
    return related(rows.select("sbom_id", *[F.regexp_extract("r", line, i).alias(n) for i, n in ((1, "src"), (2, "kind"), (3, "dst"))]))


def spdx_edges(documents: DataFrame) -> DataFrame:
    kind = "array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>"
    rows = documents.filter("format = 'spdx-json'").select("sbom_id", F.explode(F.from_json(F.get_json_object("text", "$.relationships"), kind)).alias("r"))
    return related(rows.select("sbom_id", F.col("r.spdxElementId").alias("src"), F.col("r.relationshipType").alias("kind"), F.col("r.relatedSpdxElement").alias("dst")))


def nested_by_containment(components: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components with the parent that contains them, by the first name of several, and the other edges."""
    inside = edges.filter("rel = 'contains'").groupBy("sbom_id", F.col("dst").alias("bom_ref")).agg(F.min("src").alias("parent"))
    return components.join(inside, ["sbom_id", "bom_ref"], "left"), edges.filter("rel <> 'contains'")


def spdx_id(value: Column) -> Column:
    return F.concat(F.lit("SPDXRef-"), F.regexp_replace(value, "[^A-Za-z0-9.-]", "-"))


def component_json(components: DataFrame) -> Column:
    """A component as CycloneDX JSON, without what is empty."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.to_json(F.struct(F.col("ctype").alias("type"), F.col("bom_ref").alias("bom-ref"), some("name").alias("name"), some("version").alias("version"), some("purl").alias("purl"), F.when(F.col("supplier") != "", F.struct(F.col("supplier").alias("name"))).alias("supplier")))


def cyclonedx_lines(components: DataFrame) -> DataFrame:
    """One JSON text a component: a document is written as a dataset, never gathered in one row."""
    return components.select("ord", component_json(components).alias("json"))


def spdx_lines(components: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    refs = F.when(F.col("purl") != "", F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))))
    return components.select("ord", F.to_json(F.struct(spdx_id(F.col("bom_ref")).alias("SPDXID"), F.col("name"), some("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), refs.alias("externalRefs"))).alias("json"))
