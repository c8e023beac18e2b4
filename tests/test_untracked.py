from datetime import date

from pyspark.sql import functions as F

from bomlake.operators import enrichment, lifecycles, properties, untracked


def test_categories_of_odd_files(spark):
    rows = [(None, None, ""), ("", b"", ""), ("/tmp/x", b"MZ", "noise"), ("a/tmp/x", b"MZ", "executable"), (".cache/x", None, "noise"), ("x.zip", b"PK\x03\x04", "archive"), ("x.zip", b"#!", "script"), ("x.cache", b"\x7fELF", "noise"), ("x.PEM", b"\x7fELF", "config"), ("lib.a", None, "static-archive"), ("a.d/b", b"PK", "")]
    df = spark.createDataFrame([(i, p, h, i) for i, (p, h, _) in enumerate(rows)], "ord int, path string, head binary, size long")
    got = [r.c for r in df.orderBy("ord").select(untracked.category(F.col("path"), F.col("head")).alias("c")).collect()]
    assert got == [c or "unknown" for *_, c in rows]
    assert untracked.scanned(df.limit(0)).count() == 0
    assert [r.ord for r in untracked.capped(df, 2).collect()] == [0, 1]
    sizes = spark.createDataFrame([("library", 4095), ("library", 4096), ("script", 9999)], "c string, n long")
    assert [tuple(r) for r in sizes.select(untracked.looked_up(F.col("c"), F.col("n")), untracked.looked_up(F.col("c"), F.col("n"), ("script",))).collect()] == [(False, False), (True, True), (False, True)]


def test_lifecycle_values(spark):
    raws = ['"2026-04-30"', "true", " false ", "null", "", None, '"2026-4-30"', '"2026-02-30"', "5", '"2026\\u002d04-30"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string").orderBy("i")
    day = date(2026, 4, 30)
    assert [tuple(x.d) for x in df.select(lifecycles.date_or_flag(F.col("r")).alias("d")).collect()] == [(day, ""), (None, "true"), (None, "false"), *[(None, "")] * 6, (day, "")]
    assert [x.d for x in df.select(lifecycles.long_term(F.col("r")).alias("d")).collect()] == [True, True, False, False, False, False, True, True, False, True]
    times = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-13-02T03:04:05Z", "", None]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(F.date_format(properties.moment(F.col("t")), "yyyy-MM-dd HH:mm:ss.S").alias("t")).collect()
    assert [r.t for r in got] == ["2024-01-02 03:04:05.0", "2024-01-02 01:04:05.5", "2024-01-02 03:04:05.0", None, None, None, None]


def test_products(spark):
    rows = [("a", "pkg:deb/debian/x", "node", "12.4.1"), ("b", "pkg:npm/x", "NODE", "20.1"), ("c", None, "Python", "3"), ("d", "", None, "1"), ("e", "PKG:DEB/debian", "jq", None), ("f", "pkg:rpm/opensuse", "", None)]
    got = lifecycles.products(spark.createDataFrame(rows, "bom_ref string, purl string, name string, version string")).collect()
    assert [tuple(r) for r in got] == [("a", "debian", "12"), ("b", "nodejs", "20"), ("c", "python", "3"), ("f", "opensuse", "")]


def test_outcomes(spark):
    rows = [(1, 1, 404), (1, 2, 200), (1, 3, 200), (2, 1, 404), (2, 2, 503), (3, 1, 429), (3, 2, None), (4, 1, 404), (5, 1, 301)]
    got = {r.request: (r.outcome, r.endpoint) for r in enrichment.outcomes(spark.createDataFrame(rows, "request int, ord int, status int")).collect()}
    assert got == {1: ("found", 2), 2: ("transient", None), 3: ("error", None), 4: ("not-found", None), 5: ("error", None)}


def test_unions_by_key(spark):
    kind = "array<struct<id:string,name:string,url:string,expression:string>>"
    own, more = [(None, None, None, "MIT"), ("", "Own", "", "")], [("MIT", "", "u", None), ("", "", "x", ""), ("BSD", None, "u", None), ("BSD", "B", "v", None), (None, "Own", None, None), (None, "New", None, None)]
    df = spark.createDataFrame([(own, more), (None, more[2:3]), (own, None)], f"a {kind}, b {kind}")
    got = [[x.id or x.name or x.expression for x in r.c] for r in df.select(enrichment.with_licences(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [["MIT", "Own", "BSD", "New"], ["BSD"], ["MIT", "Own"]]
    kind = "array<struct<algorithm:string,value:string>>"
    df = spark.createDataFrame([([("sha256", "a")], [("SHA-256", "b"), ("SHA-1", "c"), ("sha1", "d"), ("md5", ""), ("", "e")]), (None, None)], f"a {kind}, b {kind}")
    assert [[tuple(x) for x in r.c] for r in df.select(enrichment.with_hashes(F.col("a"), F.col("b")).alias("c")).collect()] == [[("sha256", "a"), ("sha1", "c")], []]
