"""Lookups: odd packages, endpoints, POMs, catalogues, digests, live files."""

import pytest
from bomlake.functions import identifiers, lookups
from bomlake.operators import images, search
from bomlake.sources import registries
from pyspark.sql import functions as F


def test_paths_and_coordinates_of_odd_packages(spark):
    purls = {
        "pkg:npm/%40scope/na+me@1.0 b": ("npm/npmjs/@scope/na+me/1.0 b", "/@scope%2Fna+me/1.0%20b"), "pkg:npm/x@1?a=b": ("npm/npmjs/-/x/1", "/x/1"), "pkg:maven/x@1": (None, None),
        "pkg:golang/github.com/Azure/SDK@v1": ("git/github/github.com/Azure/SDK/v1", "/github.com/!azure/!s!d!k/@v/v1.info"), "pkg:golang/x@v1": (None, "/x/@v/v1.info"), "pkg:pypi/x": (None, None), "pkg:deb/debian/x@1": (None, None), "none": (None, None),
    }
    df = spark.createDataFrame([(p,) for p in purls], "purl string").withColumn("p", identifiers.parse_purl(F.col("purl")))
    assert {r.purl: (r.c, r.t) for r in df.select("purl", lookups.coordinates(F.col("p")).alias("c"), lookups.path(F.col("p")).alias("t")).collect()} == purls
    guesses = {"github.com/a/b/c": "https://github.com/a/b", "github.com/a": "", "sr.ht/~a/b": "https://sr.ht/~a/b", "example.org/a/b": "", "": ""}
    df = spark.createDataFrame([(g,) for g in guesses], "m string")
    assert {r.m: r.g for r in df.select("m", lookups.repository_guess(F.col("m")).alias("g")).collect()} == guesses


def test_endpoints_in_order(spark):
    requests = spark.createDataFrame([(1, "a", "/x"), (2, "b", ""), (3, "c", "y"), (4, None, "z")], "request int, kind string, suffix string")
    mirrors = spark.createDataFrame([("a", 0, "http://f/", "fallback"), ("a", 1, "http://r:8/p//", "replace"), ("b", 0, "h/q", None)], "kind string, ord int, url string, mode string")
    upstreams = spark.createDataFrame([("a", "http://u"), ("b", "http://u/"), ("c", "")], "kind string, url string")
    got = lookups.endpoints(requests, mirrors, upstreams).orderBy("request", "place").collect()
    assert [(r.request, r.url, r.source) for r in got] == [(1, "http://r:8/p/x".replace("/p/x", "/p/x"), "r"), (1, "http://f/x", "f"), (2, "h/q", "h"), (2, "http://u", "upstream")]


def test_poms(spark):
    rows = [("a", "g", "<project><licenses><license><name>ISC</name></license><license><name/></license><license><name>MISC</name></license></licenses><scm><url>u.git</url></scm></project>"), ("b", "", "<project/>"), ("c", "g", "no xml"), ("d", None, None)]
    got = {r.purl_key: r for r in registries.maven(spark.createDataFrame(rows, "purl_key string, namespace string, text string")).collect()}
    assert [tuple(x) for x in got["a"].licences] == [("ISC", "ISC"), ("ISC", "MISC")] and (got["a"].supplier, got["a"].repository) == ("g", "u")
    assert (got["b"].supplier, got["b"].licences, got["b"].hashes) == ("", [], []) and "d" not in got


def test_catalogues_digests_and_coverage(spark):
    files = spark.createDataFrame([("x", "sha256", " AB "), ("y", "SHA1", "ab"), ("z", None, None)], "path string, alg string, digest string")
    one = spark.createDataFrame([("sha256 ", "ab", 1, "old"), ("sha256", "AB", 2, "new")], "alg string, digest string, ord int, name string")
    got = {r.path: (r.name, r.catalogue) for r in images.fingerprinted(files, one.limit(0), one).collect()}
    assert got == {"x": ("new", 1), "y": (None, None), "z": (None, None)}
    contents = spark.createDataFrame([("a", bytearray(b"")), ("b", None)], "path string, content binary")
    assert {r.path: [h.value and h.value[:4] for h in r.hashes] for r in images.hashed(contents, "sha512", "sha1").collect()} == {"a": ["e3b0", "cf83", "da39"], "b": [None] * 3}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(images, "MOST_HASHED", -1)
        with pytest.raises(Exception, match="too large to hash"):
            images.hashed(contents).collect()
    assert images.coverage(spark.createDataFrame([], "cpe string, purl string, origin string")).first() == (0, 0.0, 0.0, 0.0)


def test_live_files_of_a_layer_may_repeat(spark):
    rows = [(0, 0, "a", "add"), (1, 0, "a", "add"), (1, 1, "a", "add"), (1, 2, "b", "add"), (2, 0, "b", "wh"), (2, 1, "c", "add"), (3, 0, "d/e", "add"), (4, 0, "d", "opq")]
    got = images.live_files(spark.createDataFrame(rows, "layer int, seq int, path string, op string"))
    assert sorted((r.path, r.layer, r.seq) for r in got.collect()) == [("a", 1, 0), ("a", 1, 1), ("c", 2, 1)]


def test_addresses_are_made_once_for_equal_requests(spark):
    """The text of an address is made before it meets the requests; a null suffix keeps its row."""
    requests = spark.createDataFrame([(1, "k", "p"), (2, "k", "p"), (3, "k", None)], "request long, kind string, suffix string")
    mirrors = spark.createDataFrame([("k", 1, "https://m/", None)], "kind string, ord long, url string, mode string")
    got = lookups.endpoints(requests, mirrors, mirrors.select("kind", "url").limit(0))
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.request, r.url) for r in got.collect()) == [(1, "https://m/p"), (2, "https://m/p"), (3, None)]


def test_packages_meet_only_fitting_versions(spark):
    """Words are compared before packages are joined; a version that is pinned, open or not stated finds its names."""
    cpe = lambda name, v: f"cpe:2.3:a:acme:{name}:{v}:*:*:*:*:*:*:*"
    names = spark.createDataFrame([(cpe("red_gear", v),) for v in ("1", "2", "*", "-")] + [(cpe("red", "1"),)], "cpe string")
    components = spark.createDataFrame([("a", "pkg:npm/red-gear@1"), ("b", "pkg:npm/red-gear"), ("c", "pkg:npm/blue@1")], "bom_ref string, purl string")
    got = search.searched(components, names)
    assert "array_except" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.bom_ref, r.cpe.split(":")[5]) for r in got.collect()) == [("a", "*"), ("a", "-"), ("a", "1"), ("b", "*"), ("b", "-"), ("b", "1"), ("b", "2")]
