"""Extraction, snapshots, the table of answers, base differences: odd rows, repeated and broken runs."""

import datetime as dt

import pytest
from bomlake.operators import cache, extraction, origins
from bomlake.sources import snapshots
from pyspark.sql import functions as F


def test_only_wanted_parts_are_read(spark, tmp_path, monkeypatch):
    """The scan is pruned to the parts of wanted paths; every owner is served; the same where too many are wanted for a broadcast."""
    contents = spark.range(500).selectExpr("concat('d/f', id) AS path", "id AS ord", "repeat('x', 50) AS body")
    extraction.stored(contents, f"{tmp_path}/c")
    components = spark.createDataFrame([("a", 1, ["/d/f7", "", None]), ("b", 2, ["d/./f7", "./d/f9"]), ("c", 3, []), ("e", 4, None), ("f", 5, ["gone"])], "bom_ref string, ord long, locations array<string>")
    index = extraction.owners(components)
    read = extraction.wanted(spark.read.parquet(f"{tmp_path}/c"), index)
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.owner) for r in read.join(index, "path").select("path", "owner").collect()) == [("d/f7", "a"), ("d/f7", "b"), ("d/f9", "b")]
    monkeypatch.setattr(extraction, "BROADCAST_PATHS", 0)
    assert sorted(r.path for r in extraction.wanted(spark.read.parquet(f"{tmp_path}/c"), index).collect()) == ["d/f7", "d/f9"]
    assert extraction.wanted(spark.read.parquet(f"{tmp_path}/c"), index.limit(0)).count() == 0


def test_dependencies_of_several_owners_and_files(spark):
    index = spark.createDataFrame([("p", "a", 1), ("q", "a", 1), ("p", "b", 2), ("p", "b", 2)], "path string, owner string, ord long")
    deps = "array<struct<name:string,version:string,purl:string>>"
    identities = spark.createDataFrame([("q", 1, "go", [("x", "1", "pkg:x"), ("", "", "pkg:n"), ("y", "1", "")]), ("p", 2, None, [("x2", "2", "pkg:x"), ("y", "1", ""), ("z", None, "pkg:z")]), ("r", 0, "rust", None)], f"path string, ord long, source string, deps {deps}")
    existing = spark.createDataFrame([("b", "pkg:z"), ("b", "")], "owner string, purl string")
    got = extraction.attached(index, identities, existing)
    rows = sorted((r.owner, r.name, r.purl) for r in got.collect())
    # a package URL once an owner, as first found; dependencies without one as often as they are found
    assert rows == [("a", "x", "pkg:x"), ("a", "y", ""), ("a", "y", ""), ("a", "z", "pkg:z"), ("b", "x2", "pkg:x"), ("b", "y", ""), ("b", "y", "")]
    assert {r.owner: r.source for r in extraction.sources(got).collect()} == {"a": "go"}


def test_lifted_components_against_a_plain_version(spark):
    top = [(0, "t0", "n", "1", ""), (1, None, "m", "", "pkg:m"), (2, "t2", "", "", ""), (3, "t3", "n", "1", "")]
    nested = [(0, 0, "", "", "s", "", ""), (0, 1, "", "", "m2", "", "pkg:m"), (0, 2, "own", "file", "s", "", ""), (1, 0, "", "", "n", "1", ""), (1, 1, "", "", None, None, None), (1, 2, "", "", "u", "2", "pkg:u"), (3, 0, "", "", "u", "3", "pkg:u"), (3, 1, "", "", "u", "3", "pkg:u")]
    text = lambda x: x or ""
    key = lambda n, v, p: p or (f"{n}@{v}" if n else "")
    ref = lambda r, n, v, p: r or p or f"{n}@{v or 'unknown'}"
    known, added, edges = {}, [], []
    for _, r, n, v, p in top:
        known.setdefault(key(text(n), text(v), text(p)) or object(), ref(text(r), text(n), text(v), text(p)))
    for o, r, n, v, p in top:
        seen = set()
        for parent, _, sr, kind, sn, sv, sp in nested:
            k = key(text(sn), text(sv), text(sp))
            if parent != o or not k:
                continue
            if k not in known:
                known[k] = ref(text(sr), text(sn), text(sv), text(sp))
                added.append((known[k], kind or "library", ref(text(r), text(n), text(v), text(p))))
            if known[k] not in seen:
                seen.add(known[k])
                edges.append((ref(text(r), text(n), text(v), text(p)), known[k]))
    got, links = extraction.lifted(spark.createDataFrame(top, "ord int, bom_ref string, name string, version string, purl string"), spark.createDataFrame(nested, "parent int, pos int, bom_ref string, ctype string, name string, version string, purl string"))
    assert [(r.bom_ref, r.ctype, r.embedded_in) for r in got.orderBy("place").collect()] == added
    assert [(r.src, r.dst) for r in links.orderBy("ord").collect()] == edges


SNAPSHOT = '{"_note": 3, "NodeJS": [{"cycle":"18","releaseDate":"2022-04-19","support":"2023-10-18","eol":"2025-04-30","latest":"18.1","lts":"2022-10-25"},{"cycle":"v9","eol":true,"support":false,"lts":false,"extra":1},{"eol":null}], "empty": []}'


def test_snapshots_of_lifecycles(spark, tmp_path):
    c = snapshots.cycles(spark.createDataFrame([(SNAPSHOT,)], "text string"))
    rows = {r.pos: r for r in c.collect()}
    assert rows[0].asDict() == {"product": "nodejs", "pos": 0, "cyc": "18", "rel": dt.date(2022, 4, 19), "support": dt.date(2023, 10, 18), "support_flag": "", "eol": dt.date(2025, 4, 30), "eol_flag": "", "latest": "18.1", "lts": True}
    assert (rows[1].eol, rows[1].eol_flag, rows[1].support_flag, rows[1].lts) == (None, "true", "false", False) and (rows[2].eol, rows[2].eol_flag, rows[2].cyc) == (None, "", "")
    for broken in ("[", '{"a": 3}', "3"):
        with pytest.raises(Exception, match="no snapshot"):
            snapshots.cycles(spark.createDataFrame([(broken,)], "text string")).collect()
    folder = f"{tmp_path}/s"
    for _ in range(2):  # the second replaces the first
        snapshots.published(c, folder)
    assert sorted(map(str, snapshots.read(spark, folder).collect())) == sorted(map(str, c.collect()))
    assert [p.name for p in tmp_path.iterdir()] == ["s"]
    assert snapshots.document(c.limit(0)).first().text == "{}" and snapshots.cycles(spark.createDataFrame([("{}",)], "text string")).count() == 0


def test_cycles_match_with_and_without_v(spark):
    c = snapshots.cycles(spark.createDataFrame([(SNAPSHOT,)], "text string"))
    wanted = spark.createDataFrame([("a", "nodejs", "v18"), ("b", "nodejs", "v9"), ("c", "nodejs", "9"), ("d", "nodejs", ""), ("e", "nodejs", None), ("f", "other", "1")], "bom_ref string, product string, version string")
    got = {r.bom_ref: (r.cyc, r.source, r.status) for r in snapshots.stamped(snapshots.matched(wanted, c.filter("cyc = '18'"), c), F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"a": ("18", 0, "maintenance"), "b": ("v9", 1, "eol")}


def test_answers_are_kept_once(spark, tmp_path):
    """Runs that are repeated, and one that breaks off, leave one row a key; expired entries go, layers are asked in order."""
    schema, folder, at = "key string, value string, fetched_at timestamp", f"{tmp_path}/cache", lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s)
    rows = lambda *r: spark.createDataFrame([(k, v, at(s)) for k, v, s in r], schema)
    assert cache.read(spark, folder).count() == 0
    first = rows(("a", "1", 0), ("a", "0", 0), ("b", None, 5), (None, "x", 1), ("c", "old", 0))
    for _ in range(2):
        cache.stored(first, folder)
    cache.stored(rows(("a", "2", 9), ("c", "older", -5)), folder)
    bad = rows(("b", "z", 50)).withColumn("value", F.raise_error(F.lit("broke off")).cast("string"))
    with pytest.raises(Exception, match="broke off"):
        cache.stored(bad, folder)
    assert {r.key: r.value for r in cache.read(spark, folder).collect()} == {"a": "2", "b": None, "c": "old"}
    told, up = cache.answered(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "key string"), [rows(("a", "mem", 8), ("b", "stale", -99)), cache.read(spark, folder)], F.lit(at(10)), 9)
    assert {r.key: (r.layer, r.value) for r in told.collect()} == {"a": (0, "mem"), "b": (1, None), "c": (None, None), "d": (None, None)}
    assert [r.key for r in up.collect()] == ["b"]
    cache.stored(rows(("a", "3", 20)), folder, F.col("fetched_at") < F.lit(at(100)))
    assert {r.key: r.value for r in cache.read(spark, folder).collect()}["a"] == "3"


def test_images_of_every_kind_in_one_plan(spark):
    image = "image string, base string, reachable boolean, digest_label boolean, n_layers int, scanned boolean, compared boolean, prefix int"
    images = spark.createDataFrame([("content", "b", True, None, 3, True, True, 2), ("prefix", "b", True, None, 3, False, True, 2), ("paths", "b", True, None, 3, None, True, None), ("partial", "b", False, True, 3, None, None, None), ("small", "b", False, True, 1, None, None, None), ("none", "", None, None, 3, True, True, 0), ("off", None, None, None, 3, None, None, None), ("failed", "b", True, None, 3, False, False, 1)], image)
    paths = {"hit": ["/x", "same"], "moved": ["other", "copy"], "changed": ["edited"], "own": ["mine"], "bare": [], "null": None}
    rows = [(i, c, "app" if c == "own" else "", {"hit": 0, "moved": 2}.get(c, None), p) for i in [r.image for r in images.collect()] for c, p in paths.items()]
    components = spark.createDataFrame(rows, "image string, bom_ref string, origin string, layer int, paths array<string>")
    f = lambda *x: spark.createDataFrame([(r.image, p, h, n) for r in images.collect() for n, (p, h) in enumerate(x)], "image string, path string, h string, ord int")
    target = f(("same", "0"), ("same", "1"), ("copy", "1"), ("edited", "9"), ("mine", "8"))
    got = {}
    for r in origins.origins(images, components, target, f(("same", "1"), ("again", "1"), ("edited", "5"))).collect():
        got.setdefault(r.image, {})[r.bom_ref] = (r.origin, r.base_path, r.state, r.confidence, r.strategy)
    blank = lambda o, s, c="": (o, "", "", c, s)
    assert got["content"] == {"hit": ("base", "same", "", "", "content"), "moved": ("base", "same", "", "", "content"), "changed": ("base", "", "modified", "", "content"), "own": blank("app", "content"), "bare": blank("unknown", "content"), "null": blank("unknown", "content")}
    assert got["prefix"] == {c: blank({"hit": "base", "moved": "app"}.get(c, "unknown"), "path-fallback") for c in paths}
    assert got["partial"] == {c: blank({"hit": "base", "moved": "app"}.get(c, "unknown"), "unavailable", "low") for c in paths}
    assert got["paths"] == {c: blank("base" if c in ("hit", "changed") else "app", "path-fallback") for c in paths}
    for kind in ("small", "none", "off", "failed"):
        assert got[kind] == {c: blank("app" if c == "own" else "unknown", "unavailable") for c in paths}


def test_records_merge_as_one_after_the_other(spark):
    """Against a version that folds the members of a group pairwise, in order."""
    import random

    from bomlake.operators import dedup
    from bomlake.sources import records

    r = random.Random(9)
    rows = []
    for i in range(250):
        purl = r.choice(["", "pkg:a/x@1", "pkg:A/X@1?q", "pkg:b/y", "pkg:c/z"])
        hashes = [(r.choice(["sha256", "md5", "MD5"]), r.choice(["", "aa", "AA", "b"])) for _ in range(r.randrange(3))]
        licences = [(r.choice(["", "MIT"]), r.choice(["", " mit", "Own"]), r.choice(["", "A OR B", "a or b "]), "u") for _ in range(r.randrange(3))]
        evidence = r.choice([None, ("", 0.0, []), ("m", 0.0, ["/a"]), ("n", 0.5, [r.choice(["/a", "/b", "/c"]) for _ in range(3)])])
        layer = r.choice([None, None, ("d", r.randrange(3), "", "")])
        props = r.choice([None, {}, {"k": r.choice("xyz")}, {"k": "x", "o": str(i % 3)}])
        rows.append({"ord": i, "bom_ref": f"r{i}", "ctype": "library", "name": r.choice(["", "n"]), "version": r.choice(["", "1"]), "purl": purl, "supplier": "", "cpes": [r.choice(["", " ", "cpe:A", "cpe:a ", "cpe:b"]) for _ in range(r.randrange(3))], "hashes": hashes, "licences": licences, "evidence": evidence, "props": props, "layer": layer})

    def key(c):
        cpe = next((x for x in c["cpes"] if x.strip()), "")
        sha = next((v for a, v in c["hashes"] if a == "sha256"), "")
        if c["purl"]:
            return c["purl"].split("?")[0].lower()
        return ("cpe", cpe.strip().lower()) if cpe else ("sha", sha.lower()) if sha else ("nv", c["name"]) if c["name"] and c["version"] else c["ord"]

    def strength(c):
        return 100 * bool(c["purl"]) + 10 * any(x.strip() for x in c["cpes"]) + (len(c["evidence"][2]) if c["evidence"] else 0)

    def unique(items, same):
        seen = {}
        for x in items:
            if same(x) not in ("", "|"):
                seen.setdefault(same(x), x)
        return list(seen.values())

    groups = {}
    for c in rows:
        groups.setdefault(key(c), []).append(c)
    want = {}
    for members in groups.values():
        primary = max(members, key=lambda c: (strength(c), -c["ord"]))
        out = dict(primary, props=dict(primary["props"] or {}))
        order = [primary, *[c for c in members if c is not primary]]
        if len(members) > 1:
            out["cpes"] = unique([x for c in order for x in c["cpes"]], lambda x: x.strip().lower())
            out["hashes"] = unique([x for c in order for x in c["hashes"]], lambda h: h[1] and f"{h[0]}:{h[1]}".lower())
            out["licences"] = unique([x for c in order for x in c["licences"]], lambda x: x[2].strip().lower() or f"{x[0].strip()}|{x[1].strip()}".lower())
            for c in order[1:]:
                for k, v in (c["props"] or {}).items():
                    if out["props"].setdefault(k, v) != v:
                        out["props"][f"bom:dedup:conflict:{k}"] = v
                if c["layer"] and out["layer"] and c["layer"][1] != out["layer"][1]:
                    out["props"]["bom:dedup:also-in-layer"] = str(c["layer"][1])
                out["layer"] = out["layer"] or c["layer"]
                if c["evidence"]:
                    e = out["evidence"] or ("", 0.0, [])
                    out["evidence"] = (e[0] or c["evidence"][0], e[1] or c["evidence"][1], e[2] + [p for i, p in enumerate(c["evidence"][2]) if p not in e[2] and p not in c["evidence"][2][:i]])
            out["props"]["bom:dedup:merged-count"] = str(len(members) - 1)
        want[out["bom_ref"]] = (len(members), members[0]["ord"], out["cpes"], out["hashes"], out["licences"], out["evidence"], out["props"], out["layer"])
    schema = "ord int, " + ", ".join(f"{c} {records.RECORD[c]}" for c in rows[0] if c != "ord")
    df = spark.createDataFrame([tuple(c.values()) for c in rows], schema)
    plain = lambda x: None if x is None else tuple(x)
    for g in dedup.merged(df).collect():
        got = (g.members, g["first"], g.cpes, [tuple(h) for h in g.hashes], [tuple(x) for x in g.licences], plain(g.evidence), g.props or {}, plain(g.layer))
        assert got == want.pop(g.bom_ref)
    assert not want
    assert dedup.merged(df.limit(0)).count() == 0


def test_levels_of_a_dag_and_a_cycle(spark):
    import random

    from bomlake.operators import inventory

    r = random.Random(2)
    edges = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 60) for _ in range(r.randrange(1, 4))] + [("n5", "n4")] * 3
    level = {"n0": 0}
    for i in range(1, 60):
        level[f"n{i}"] = 1 + max(level[d] for n, d in edges if n == f"n{i}")
    table = lambda rows: spark.createDataFrame(rows, "name string, dep string")
    assert {x.name: x.level for x in inventory.levels(table(edges)).collect()} == level
    with pytest.raises(ValueError):
        inventory.levels(table([*edges, ("n3", "n50"), ("a", "a")]))
    assert inventory.levels(table(edges).limit(0)).count() == 0


def test_owners_with_equal_places_share_their_dependencies(spark):
    """Classes give what each owner gives by itself, and have one owner's rows only."""
    components = spark.createDataFrame([(f"o{i}", i, ["a"] if i % 3 else ["b", "/a"]) for i in range(12)], "bom_ref string, ord int, locations array<string>")
    deps = "array<struct<name:string,version:string,purl:string>>"
    identities = spark.createDataFrame([("a", 1, "go", [("x", "1", "p:x"), ("y", "", ""), ("y", "", "")]), ("b", 0, "", [("x", "2", "p:x"), ("z", "1", "p:z")])], f"path string, ord int, source string, deps {deps}")
    existing = spark.createDataFrame([("o4", "p:x"), ("o7", "")], "owner string, purl string")
    index = extraction.owners(components)
    plain = extraction.attached(index, identities, existing).select("owner", "name", "version", "purl", "source")
    few, had, members = extraction.alike(index, existing)
    got = extraction.attached(few, identities, had)
    assert got.select("owner").distinct().count() == 3 and members.count() == 12
    out = extraction.expanded(got.withColumnRenamed("owner", "class"), members.select("class", "owner")).select(*plain.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
