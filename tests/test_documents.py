"""Whole documents: written, read back, odd values; typed fields."""

import json

import pytest
from bomlake.operators import compliance, sarif, typed
from bomlake.sources import documents, records, writers
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ", ".join(f"{k} {v}" for k, v in {"sbom_id": "string", "place": "string", **records.RECORD}.items())
NONE = dict.fromkeys(("bom_ref", "grp", "name", "version", "description", "scope", "purl", "author", "publisher", "copyright", "supplier", "origin"), "") | {"ctype": "library", "cpes": [], "hashes": [], "licences": [], "evidence": None, "props": None, "layer": None}
EDGES = "sbom_id string, ord long, src string, dst string, rel string"
DOCS = "sbom_id string, created timestamp, authors array<string>, tools array<struct<vendor:string,name:string,version:string>>, props map<string,string>, own_props map<string,string>"


def table(spark, rows):
    return spark.createDataFrame([tuple((NONE | r)[f.name] for f in T._parse_datatype_string(RECORD).fields) for r in rows], RECORD)


def bill(spark):
    rows = [
        {"sbom_id": "a", "place": "", "bom_ref": "root", "name": 'the "app"\\', "ctype": "application"},
        {"sbom_id": "a", "place": "/00000000", "bom_ref": "x/1", "name": "x", "version": "1", "cpes": ["c0", "c1", "c2"], "origin": "base", "layer": ("d", 3, "", "RUN"), "props": {"z": "1", "bom:origin": "old"}, "hashes": [("sha256", "aa"), ("odd", "bb")], "evidence": ("purl", 0.5, ["/a", "/b"])},
        {"sbom_id": "a", "place": "/00000000/00000001", "bom_ref": "y", "name": "y\né", "licences": [("MIT", "", "", "u"), ("", "", "A OR B", ""), ("", "", "", "")], "description": "d"},
        {"sbom_id": "a", "place": "/00000000/00000001/00000000", "bom_ref": "z", "name": "z", "supplier": "s"},
        {"sbom_id": "a", "place": "/00000000/00000003", "bom_ref": "w", "name": "w"},
        {"sbom_id": "a", "place": "/00000002", "bom_ref": "", "name": "n o", "version": "2", "copyright": "c"},
        {"sbom_id": "b", "place": "/00000005", "bom_ref": "x/1", "name": "other"},
    ]
    edges = [("a", 1, "x/1", "y", "depends-on"), ("a", 2, "w", "q", "contains"), ("a", 3, "x/1", "w", "provides"), ("a", 4, "z", "x/1", "depends-on"), ("a", 5, "x/1", "z", "depends-on"), ("a", 6, "v", "v", "unknown")]
    docs = [("a", None, ["me"], [("m", "t", "1"), ("", "u", "")], {"k": 'v"'}, None), ("b", None, [], None, None, {"o": "p"}), ("c", None, None, None, None, None)]
    return spark.createDataFrame(docs, DOCS), table(spark, rows), spark.createDataFrame(edges, EDGES)


@pytest.fixture(scope="module")
def cyclonedx(spark):
    return writers.cyclonedx(*bill(spark))


def test_cyclonedx_documents(spark, cyclonedx):
    texts = {r.sbom_id: json.loads(r.text) for r in writers.assembled(cyclonedx).collect()}
    a = texts["a"]
    assert [c["name"] for c in a["components"]] == ["x", "n o"] and [c["name"] for c in a["components"][0]["components"]] == ["y\né", "w"]
    assert a["components"][0]["components"][0]["components"][0]["supplier"] == {"name": "s"}
    assert a["metadata"]["component"]["name"] == 'the "app"\\' and a["metadata"]["properties"] == [{"name": "k", "value": 'v"'}]
    # sources as first seen, also those without a written target; targets in order
    assert a["dependencies"] == [{"ref": "x/1", "dependsOn": ["y", "z"], "provides": ["w"]}, {"ref": "w"}, {"ref": "z", "dependsOn": ["x/1"]}, {"ref": "v"}]
    x = a["components"][0]
    assert x["cpe"] == "c0" and x["hashes"] == [{"alg": "SHA-256", "content": "aa"}, {"alg": "odd", "content": "bb"}]
    assert {p["name"]: p["value"] for p in x["properties"]} == {"z": "1", "bom:origin": "base", "bom:layer:digest": "d", "bom:layer:index": "3", "bom:layer:added-by": "RUN", "bom:cpe:1": "c1", "bom:cpe:2": "c2"}
    assert x["evidence"] == {"identity": [{"field": "purl", "confidence": 0.5}], "occurrences": [{"location": "/a"}, {"location": "/b"}]}
    assert texts["a"]["components"][0]["components"][0]["licenses"] == [{"license": {"id": "MIT", "url": "u"}}, {"expression": "A OR B"}]
    assert "dependencies" not in texts["b"] and texts["b"]["properties"] == [{"name": "o", "value": "p"}]
    assert texts["c"] == {"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1}


def test_fragments_in_order_are_the_document(spark, cyclonedx):
    rows = [r for p in writers.ordered(cyclonedx).rdd.glom().collect() for r in p if r.sbom_id == "a"]
    assert json.loads("\n".join(r.text for r in rows)) == json.loads(writers.assembled(cyclonedx).filter("sbom_id = 'a'").first().text)
    with pytest.raises(Exception, match="too large for one text"):
        writers.assembled(cyclonedx, 100).collect()


def test_cyclonedx_documents_are_read_as_they_were_written(spark, cyclonedx):
    _, rows, edges = bill(spark)
    texts = writers.assembled(cyclonedx).withColumn("format", F.lit("cyclonedx-json"))
    read = {r.bom_ref or r.name: r for r in records.cyclonedx_records(texts).filter("sbom_id = 'a'").collect()}
    assert {k: r.place for k, r in read.items()} == {"x/1": "/00000000", "y": "/00000000/00000000", "z": "/00000000/00000000/00000000", "w": "/00000000/00000001", "n o": "/00000001"}
    for r in rows.filter("sbom_id = 'a' AND place <> ''").collect():
        got = read[r.bom_ref or r.name]
        same = [c for c in records.RECORD if c not in ("licences", "props")]
        assert [got[c] for c in same] == [r[c] for c in same]
        assert got.licences == [x for x in r.licences if any(x)] and got.props == {k: v for k, v in (r.props or {}).items() if k != "bom:origin"}
    known = [tuple(r) for r in edges.orderBy("ord").select("src", "dst", "rel").collect() if r.rel in ("depends-on", "provides")]
    assert sorted(map(tuple, records.cyclonedx_relations(texts).select("src", "dst", "rel").collect())) == sorted(known)
    meta = records.cyclonedx_metadata(texts).filter("sbom_id = 'a'").first()
    assert meta.authors == ["me"] and [tuple(t) for t in meta.tools] == [("m", "t", "1"), ("", "u", "")] and meta.name == 'the "app"\\' and meta.props == {"k": 'v"'}


def test_spdx_documents(spark):
    texts = writers.assembled(writers.spdx(*bill(spark), created="2024-01-01T00:00:00Z"))
    a = json.loads(texts.filter("sbom_id = 'a'").first().text)
    assert [p["SPDXID"] for p in a["packages"]] == ["SPDXRef-x-1", "SPDXRef-y", "SPDXRef-z", "SPDXRef-w", "SPDXRef-n-o-2"]
    relations = [(r["spdxElementId"][8:], r["relationshipType"], r["relatedSpdxElement"][8:]) for r in a["relationships"]]
    assert relations == [
        ("y", "CONTAINS", "z"), ("x-1", "CONTAINS", "y"), ("x-1", "CONTAINS", "w"), ("DOCUMENT", "DESCRIBES", "x-1"), ("DOCUMENT", "DESCRIBES", "n-o-2"),
        ("x-1", "DEPENDS_ON", "y"), ("w", "CONTAINS", "q"), ("x-1", "DEPENDENCY_OF", "w"), ("z", "DEPENDS_ON", "x-1"), ("x-1", "DEPENDS_ON", "z"),
    ]
    assert a["name"] == 'the "app"\\' and a["packages"][1]["licenseConcluded"] == "MIT AND A OR B" and a["packages"][0]["checksums"] == [{"algorithm": "SHA256", "checksumValue": "aa"}]
    assert [r["referenceLocator"] for r in a["packages"][0]["externalRefs"]] == ["c0", "c1", "c2"] and [n["comment"] for n in a["packages"][0]["annotations"]] == ["bom:layer:added-by=RUN", "bom:layer:digest=d", "bom:layer:index=3", "bom:origin=base", "z=1"]
    rows = texts.withColumn("format", F.lit("spdx-json"))
    placed, rest = records.nested(records.spdx_packages(rows), records.spdx_relations(rows))
    up = {r.place: r.bom_ref for r in placed.filter("sbom_id = 'a'").collect()}
    assert sorted((up.get(p.rpartition("/")[0], ""), r) for p, r in up.items()) == [("", "n-o-2"), ("", "x-1"), ("x-1", "w"), ("x-1", "y"), ("y", "z")]
    # a containment whose end is not there stays a relation
    assert ("w", "q", "contains") in {tuple(r) for r in rest.select("src", "dst", "rel").collect()}


def test_containment_is_taken_in_order(spark):
    """A package under two parents is there twice, with what came before; a cycle has no top; of equal references the last is meant."""
    packages = spark.createDataFrame([("s", i, r) for i, r in enumerate(["a", "b", "c", "d", "p", "q", "a"])], "sbom_id string, ord int, bom_ref string")
    links = [("b", "c"), ("a", "b"), ("b", "d"), ("d", "b"), ("p", "q"), ("q", "p"), ("a", "gone")]
    relations = spark.createDataFrame([("s", i, *x, "contains") for i, x in enumerate(links)], EDGES)
    placed, rest = records.nested(packages, relations)
    up = {r.place: r.bom_ref for r in placed.collect()}
    tree = sorted((up.get(p.rpartition("/")[0], ""), r) for p, r in up.items())
    assert tree == [("", "a"), ("", "a"), ("a", "b"), ("a", "b"), ("b", "c"), ("b", "c")]
    assert [tuple(r) for r in rest.select("src", "dst").collect()] == [("a", "gone")]


def test_sarif_documents(spark):
    schema = "sbom_id string, ord long, bom_ref string, name string, version string, purl string, cpe string, origin string, method string, category string, confidence string, places array<string>"
    rows = spark.createDataFrame([("a", 1, "r", 'q"\\', "", "p", "", "unknown", "", "", None, ["/x"]), ("a", 2, "", "", "", "", "", None, "untracked-scan", None, "0.1", None)], schema)
    documents_ = spark.createDataFrame([("a",), ("b",)], "sbom_id string")
    texts = {r.sbom_id: json.loads(r.text) for r in writers.assembled(writers.sarif_json(documents_, rows)).collect()}
    got = texts["a"]["runs"][0]["results"]
    assert [r["ruleId"] for r in got] == ["001", "002", "003", "004"] and got[1]["message"]["text"] == r'Component "q\"\\" has Origin=unknown.'
    assert got[1]["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "x"}}}] and "locations" not in got[0]
    assert texts["b"]["runs"][0]["results"] is None and [r["id"] for r in texts["b"]["runs"][0]["tool"]["driver"]["rules"]] == [r[0] for r in sarif.RULES]


def test_typed_fields_come_back(spark):
    rows = table(spark, [{"place": "/0", "sbom_id": "a", "origin": o, "layer": x, "cpes": c, "props": p} for o, x, c, p in [("", None, [], None), ("app", ("d", 0, "l", ""), [f"c{i}" for i in range(12)], {"a": "b"}), ("", ("", 7, "", ""), ["one"], {})]])
    for numbered in (True, False):
        props = typed.dehydrated(F.col("props"), F.col("origin"), F.col("layer"), F.col("cpes") if numbered else None)
        for r in rows.select("*", typed.hydrated(props, numbered).alias("h")).collect():
            assert (r.h.origin, r.h.layer, r.h.props) == (r.origin, r.layer, r.props or {})
            assert r.h.cpes == (r.cpes[1:] if numbered else [])


def test_empty_and_broken_documents(spark):
    broken = spark.createDataFrame([("a", "cyclonedx-json", "{"), ("b", "cyclonedx-json", '{"components":[null,{"name":null}]}'), ("c", "spdx-json", '{"packages":[{}]}'), ("d", None, None)], "sbom_id string, format string, text string")
    assert [tuple(r) for r in records.cyclonedx_records(broken).select("sbom_id", "place", "name", "ctype").collect()] == [("b", "/00000001", "", "unknown")]
    assert [tuple(r) for r in records.spdx_packages(broken).select("sbom_id", "bom_ref", "name").collect()] == [("c", "", "")]
    docs, rows, edges = (x.limit(0) for x in bill(spark))
    assert writers.assembled(writers.cyclonedx(docs, rows, edges)).count() == writers.assembled(writers.spdx(docs, rows, edges, "x")).count() == 0
    assert documents.sniffed(F.lit("x")) is not None


def test_tools_and_creators(spark):
    names = {"maker scan-1.0": ("maker", "scan", "1.0"), "scan": ("", "scan", ""), "a b c-d-2": ("a b", "c-d", "2"), "-1": ("", "-1", ""), "x-": ("", "x", "")}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r.t: tuple(r.v) for r in df.select("t", records.tool_of(F.col("t")).alias("v")).collect()} == names


def test_compliance_of_nothing_and_unknown_floor(spark):
    documents_ = spark.createDataFrame([("a",)], "sbom_id string")
    found = spark.createDataFrame([], "sbom_id string, validator string, rule_id string, severity int, bom_ref string")
    assert [tuple(r) for r in compliance.statuses(documents_, found, ["ntia"]).collect()] == [("a", "ntia", "passed")]
    assert [tuple(r) for r in compliance.gate(documents_, found, "low").collect()] == [("a", 0, False)]
    with pytest.raises(ValueError):
        compliance.gate(documents_, found, "bad")


def test_policy_needs_a_named_component(spark):
    """Rules of a type fit only findings that name a component; the first of a reference counts; unknown rules keep their severity."""
    components = spark.createDataFrame([("a", "/0", "r", "application", ""), ("a", "/1", "r", "library", ""), ("a", "/2", "f", "file", ""), ("a", "/3", "n", None, "pkg:NPM/x")], "sbom_id string, place string, bom_ref string, ctype string, purl string")
    rows = [("a", "ntia", "NTIA-VERSION", 3, "r"), ("a", "ntia", "NTIA-VERSION", 3, "f"), ("a", "ntia", "NTIA-SUPPLIER", 2, "n"), ("a", "own", "OWN", 1, "r"), ("a", "ntia", "NTIA-VERSION", 0, "gone"), ("a", "spdx", "SPDX-EMPTY-PACKAGES", 0, "")]
    found = spark.createDataFrame(rows, "sbom_id string, validator string, rule_id string, severity int, bom_ref string")
    got = {(r.rule_id, r.bom_ref): r.severity for r in compliance.judged(found, components).collect()}
    assert got == {("NTIA-VERSION", "r"): 4, ("NTIA-SUPPLIER", "n"): 0, ("OWN", "r"): 1, ("NTIA-VERSION", "gone"): 3, ("SPDX-EMPTY-PACKAGES", ""): 3}


def test_places_of_a_deep_tree(spark):
    nodes = spark.createDataFrame([("s", i, i - 1 if i else None, i % 3) for i in range(300)] + [("s", 900, 901, 0), ("s", 901, 900, 0), ("s", 902, 900, 1), ("t", 1, None, 4), ("t", 2, 77, 0)], "sbom_id string, node long, parent long, ord int")
    got = {(r.sbom_id, r.node): r.place for r in compliance.placed(nodes).collect()}
    assert len(got) == 301 and got["t", 1] == "/00000004" and got["s", 299] == "".join(f"/{i % 3:08d}" for i in range(300))


def test_cycles_cost_no_rounds(spark, monkeypatch):
    """Nodes that are their own parents, one of them stated often, end the rounds once nothing else is left."""
    calls = []
    monkeypatch.setattr(compliance, "cut", lambda df, plain=compliance.cut: calls.append(1) or (plain(df) if len(calls) < 9 else pytest.fail("too many rounds")))
    rows = [("s", i, i, 0) for i in range(10, 200)] + [("s", 10, 10, 0)] * 30 + [("s", 1, None, 1), ("s", 2, 1, 2), ("s", 3, 10, 3)]
    got = compliance.placed(spark.createDataFrame(rows, "sbom_id string, node long, parent long, ord int")).collect()
    assert {(r.node, r.place) for r in got} == {(1, "/00000001"), (2, "/00000001/00000002")}


def test_fragments_and_typed_fields_are_made_once(spark):
    fragments = spark.createDataFrame([("a", 0, "", "x")], "sbom_id string, part int, key string, text string")
    plan = writers.assembled(fragments)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    for h in (typed.hydrated(F.col("mark")), records.last_of(F.col("pairs"))):
        df = spark.createDataFrame([({"a": "1"}, [("a", "1")])], f"mark map<string,string>, pairs {records.PROPERTIES}").select(h.alias("h"))
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        assert plan.count("mark#") + plan.count("pairs#") == 1


def test_rules_of_components_carry_only_what_breaks_them(spark, monkeypatch):
    """The joins that find what is within files get the rows that break a rule, without the texts."""
    rows = [("s", i, place, f"r{i}", kind, name, "1", "maker", "", purl, "", n) for i, (place, kind, name, purl, n) in enumerate([("/0", "library", "whole", "pkg:npm/whole", 1), ("/1", "library", "", "pkg:npm/x", 1), ("/2", "file", "f", "", 1), ("/2/0", "library", "", "", 0), ("/3", "framework", "y", "pkg:npm/y", 0), ("/2/1", "framework", "z", "pkg:npm/z", 0)])]
    items = spark.createDataFrame(rows, "sbom_id string, ord int, place string, bom_ref string, ctype string, name string, version string, supplier string, author string, purl string, cpe string, n_licences int").selectExpr("*", "'' AS cpe_source", "'' AS disclosure")
    boms = spark.createDataFrame([("s", "a", "now")], "sbom_id string, author string, created string")
    carried, real = [], compliance.validators.outside_files
    monkeypatch.setattr(compliance.validators, "outside_files", lambda c, of=None: carried.append(of if of is not None else c) or real(c, of))
    found = compliance.findings(boms, items, boms.select("sbom_id")).collect()
    assert {(r.rule_id, r.bom_ref) for r in found if r.validator == "ntia" or r.rule_id == "EU-CRA-ART13-LICENSE"} == {("NTIA-NAME", "r1"), ("EU-CRA-ART13-LICENSE", "r4")}
    assert sorted(sorted(r.bom_ref for r in x.collect()) for x in carried) == [["r1", "r2", "r3"], ["r4", "r5"]]
    assert not any({"name", "version", "supplier"} <= {c for c, t in x.dtypes if t == "string"} for x in carried)
