import json
import random

import duckdb
import pytest

import __spark_entry__
from bomlake import queries
from bomlake.functions import identifiers as I
from bomlake.functions import paths as P
from bomlake.operators import images, inventory, sarif
from bomlake.plans.pipeline import Operator, chosen, ordered, run
from bomlake.sources import documents
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(round(r[i], 4)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert normal(df.collect(), df.columns) == normal(cursor.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_overlay(spark):
    """Against the fold entry by entry, with whiteouts and opaque markers."""
    r = random.Random(1)
    entries = [(layer, seq, r.choice(["a/x", "a/y", "a/b/z", "b/x", "c"]), r.choice(["add", "add", "wh"])) for layer in range(5) for seq in range(6)]
    entries += [(3, 9, "a", "opq"), (4, 9, "b", "opq")]
    live = {}
    for layer, seq, path, op in sorted(entries):
        if op == "add":
            live[path] = (layer, seq)
        elif op == "wh":
            live.pop(path, None)
        else:
            live = {p: v for p, v in live.items() if not (p.startswith(path + "/") and v[0] < layer)}
    got = images.effective(spark.createDataFrame(entries, "layer int, seq int, path string, op string"))
    assert {x.path: (x.layer, x.seq) for x in got.collect()} == live


def test_paths(spark):
    cases = {"./usr/./lib/../bin/x": "usr/bin/x", "/a//b/": "a/b", "..": "..", "a/..": "", "\\a\\b": "a/b", "": "", "../../x": "../../x"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", P.normalised(F.col("p")).alias("n")).collect()} == cases


def test_purl(spark):
    cases = ["pkg:NPM/%40scope/name@1.0?arch=x#sub", "pkg:maven/org.acme/lib@1+2", "pkg:golang/github.com/a/b", "nothing", "pkg:npm", "pkg:npm/x"]
    got = [r.p for r in spark.createDataFrame([(c,) for c in cases], "u string").select(I.parse_purl(F.col("u")).alias("p")).collect()]
    assert got[0].type == "npm" and got[0].namespace == "@scope" and got[0].version == "1.0" and got[0].qualifiers == "arch=x" and got[0].subpath == "sub"
    assert got[1].version == "1+2" and got[2].namespace == "github.com/a" and got[3] is None and got[4] is None and got[5].name == "x"


def test_rules_and_policy(spark):
    df = spark.createDataFrame([("/en/12/README",), ("/en/12",), ("/en/2",), ("/x/7.html",), ("/x/a.html",), ("/it/12",), ("/q",)], "path string")
    assert [r.rule for r in images.classified(df).collect()] == ["readme", "english-ones", "english", "seven", "html", "numbers", ""]
    found = spark.createDataFrame([("NTIA-SUPPLIER", "application", "npm", 2), ("NTIA-SUPPLIER", "library", "npm", 2), ("NTIA-NAME", "file", "", 4), ("OTHER", "library", "", 1)], "rule_id string, ctype string, eco string, raw int")
    assert [r.severity for r in inventory.with_policy(found).collect()] == [3, 0, 4, 1]
    assert [r.severity for r in inventory.with_policy(found, [("NTIA-SUPPLIER", "", "npm", 1)]).collect()] == [1, 1, 4, 1]


def test_levels_reject_a_cycle(spark):
    dag = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "name string, dep string")
    assert {r.name: r.level for r in inventory.levels(dag).collect()} == {"a": 0, "b": 1, "c": 2}


def test_levels_of_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(70)], "name string, dep string")
    assert inventory.levels(chain).agg({"level": "max"}).first()[0] == 70
    with pytest.raises(ValueError, match="cycle"):
        inventory.levels(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "name string, dep string"))


def test_identity_and_primary(spark):
    """The most precise identity wins; no name or no version is no identity; places break ties before order."""
    schema = "ord long, ctype string, name string, version string, purl string, supplier string, cpe string, sha256 string, n_locations int"
    data = [
        (0, "library", "a", "1", "pkg:npm/A@1?x=y", "", "", "", 0), (1, "library", "b", "", "pkg:npm/a@1", "s", "", "", 2), (2, "library", "a", "1", "pkg:npm/a@1#sub", "", "", "", 0),
        (3, "library", "x", "1", "", "", " CPE:2.3:a:V:P:1", "aa", 0), (4, "file", "y", "2", "", "", "cpe:2.3:a:v:p:1", "", 0), (5, "file", "z", "", "", "", "", "AA", 0), (6, "library", "q", "3", "", "", "", "aa", 0),
        (7, "library", "Name", "1.0", "", "", "", "", 0), (8, "Library", "name", "1.0", "", "", None, None, None), (9, "library", "name", "", "", "", "", "", 0), (10, "library", "name", "", "", "", "", "", 0), (11, "library", None, None, None, None, "", "", 0),
    ]
    got = {r.place: (r.ord, r.members, r.key) for r in inventory.deduplicated(spark.createDataFrame(data, schema)).collect()}
    assert got == {
        0: (1, 2, "purl:pkg:npm/a@1"), 2: (2, 1, "purl:pkg:npm/a@1#sub"), 3: (3, 2, "cpe:cpe:2.3:a:v:p:1"), 5: (5, 2, "sha256:aa"),
        7: (7, 2, "nvt:library:name:1.0"), 9: (9, 1, "row:9"), 10: (10, 1, "row:10"), 11: (11, 1, "row:11"),
    }


def test_density(spark):
    files = [(f"opt/tool-1.2.3/{x}", 1) for x in ("Makefile", "configure", "src/a.c", "include/a.h", "README", "COPYING")] + [(f"opt/plain/{i}", 1) for i in range(1001)] + [("opt/x/src/a", 1), ("root", 1), (None, 1)]
    got = {r.dir: (r.score, r.name, r.version) for r in images.density(images.directories(spark.createDataFrame(files, "path string, size int"))).collect()}
    assert got["opt/tool-1.2.3"] == (15, "tool", "1.2.3") and got["opt/plain"] == (3, "", "") and got["opt/x"] == (0, "", "") and "" not in got


def test_static_analysis_results(spark):
    schema = "bom_ref string, name string, version string, purl string, cpe string, origin string, method string, category string, confidence string, places array<string>"
    data = [("r1", "n", "1", "pkg:x/n@1", "", "unknown", "untracked-scan", "", "0.5", ["/a/b", "c"]), ("r2", "", "", "", "c", "app", "", "binary", "0.70", []), ("r3", None, None, "pkg:x/y", None, None, None, None, "odd", None), ("r4", "k", "", "", "", "app", "", "", "low", None)]
    got = {(r.bom_ref, r.rule): (r.level, r.message, r.locations) for r in sarif.results(spark.createDataFrame(data, schema)).collect()}
    assert got == {
        ("r1", "001"): ("warning", 'Untracked component "n@1" found at /a/b.', "a/b,c"), ("r1", "002"): ("note", 'Component "n@1" has Origin=unknown.', "a/b,c"),
        ("r1", "003"): ("note", 'Component "n@1" (PURL "pkg:x/n@1") has no CPE.', "a/b,c"), ("r1", "004"): ("note", 'Component "n@1" has a low-confidence CPE (heuristic).', "a/b,c"),
        ("r2", "001"): ("warning", 'Untracked binary "r2".', "r2"), ("r3", "003"): ("note", 'Component "pkg:x/y" (PURL "pkg:x/y") has no CPE.', "r3"), ("r4", "004"): ("note", 'Component "k" has a low-confidence CPE (heuristic).', "r4"),
    }


def test_pipeline_order():
    op = lambda n, *after: Operator(n, lambda t: {"log": t["log"] + [n]}, after)
    ops = [op("c", "b", "missing"), op("a"), op("b", "a"), op("d")]
    assert [o.name for o in ordered(ops)] == ["a", "b", "c", "d"]
    assert run(ops, {"log": []}, disabled={"b"})["log"] == ["c", "a", "d"]
    assert [o.name for o in chosen(ops, enabled={"a", "b"}, disabled={"b"})] == ["a"]
    with pytest.raises(ValueError, match="cycle"):
        ordered([op("x", "y"), op("y", "x")])
    with pytest.raises(ValueError, match="same name"):
        ordered([op("x"), op("x")])


def test_documents(spark, tmp_path):
    bom = {"bomFormat": "CycloneDX", "components": [{"bom-ref": "a", "type": "application", "name": "app", "version": "1", "components": [{"bom-ref": "b", "type": "library", "name": "lib", "purl": "pkg:npm/lib@2"}]}], "dependencies": [{"ref": "a", "dependsOn": ["b"]}]}
    spdx = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "SPDXRef-x", "name": "x", "versionInfo": "3", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:npm/x@3"}]}]}
    for name, text in (("a.json", json.dumps(bom)), ("b.json", json.dumps(spdx)), ("c.json", "SPDXVersion: SPDX-2.3"), ("d.json", "?")):
        (tmp_path / name).write_text(text)
    docs = documents.read(spark, str(tmp_path))
    assert sorted(r.format for r in docs.collect()) == ["cyclonedx-json", "spdx-json", "spdx-tag-value", "unknown"]
    assert {(r.bom_ref, r.parent, r.depth, r.purl) for r in documents.cyclonedx_components(docs).collect()} == {("a", None, 0, ""), ("b", "a", 1, "pkg:npm/lib@2")}
    assert [(r.src, r.dst) for r in documents.cyclonedx_edges(docs).collect()] == [("a", "b")]
    assert [(r.name, r.version, r.purl) for r in documents.spdx_components(docs).collect()] == [("x", "3", "pkg:npm/x@3")]


def test_cpe_candidates_are_dealt_out_before_they_are_parsed(spark):
    """A table of one small file is one task; package URLs are parsed once, in as many as there are. Two vendors of a name, none, no package URL."""
    c = spark.createDataFrame([("a", "pkg:npm/x@1"), ("b", "pkg:npm/y@2"), ("c", ""), ("d", None), ("e", "odd"), ("f", "pkg:npm/x")], "bom_ref string, purl string")
    d = spark.createDataFrame([("npm", "", "x", "x", "x"), ("npm", "", "x", "other", "x")], "d_type string, d_ns string, d_name string, d_vendor string, d_product string")
    found = inventory.candidates(c, d)
    got = {(r.bom_ref, r.cpe.split(":")[3], r.cpe.split(":")[5], str(r.confidence), r.source) for r in found.collect()}
    assert got == {("a", "x", "1", "0.95", "dictionary+heuristic"), ("a", "other", "1", "0.95", "dictionary"), ("b", "y", "2", "0.70", "heuristic"), ("f", "x", "*", "0.95", "dictionary+heuristic"), ("f", "other", "*", "0.95", "dictionary")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Union" not in plan
