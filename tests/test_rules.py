import pytest

from bomlake.operators import images
from bomlake.sources import folders, rules

PATHS = """
version: 1
rules:
  - {name: docs, action: skip, pattern: {type: prefix, values: [/doc/, doc/]}}
  - {name: own, action: mark_as_noise, pattern: {type: regex, values: ["^/x"]}}
"""


def test_path_rules(spark):
    own = rules.path_rules(PATHS)
    assert own == [("docs", "skip", "prefix", "/doc/"), ("docs", "skip", "prefix", "doc/"), ("own", "mark_as_noise", "regex", "^/x")]
    base = [("a", "skip", "exact", "A"), ("docs", "mark_as_noise", "prefix", "/old/"), ("docs", "mark_as_noise", "prefix", "/older/"), ("z", "skip", "exact", "Z")]
    assert rules.overridden(base, own) == [base[0], *own[:2], base[3], own[2]]
    df = spark.createDataFrame([("/doc/a",), ("/x/b",), ("/old/c",)], "path string")
    assert [r.rule for r in images.classified(df, rules.overridden(base, own)).collect()] == ["docs", "own", ""]
    for bad in ("", "version: 2", PATHS.replace("own", "docs"), PATHS.replace("mark_as_noise", "burn"), PATHS.replace("name: own, ", "")):
        with pytest.raises(ValueError):
            rules.path_rules(bad)


def test_severity_overrides():
    text = "compliance: {severity_overrides: [{rule_id: R, severity: high, ecosystem: npm}, {rule_id: S, component_type: file, severity: ignored}, {rule_id: T}]}"
    assert rules.severity_overrides(text) == [("R", "", "npm", 3), ("S", "file", "", -1), ("T", "", "", 0)]
    assert rules.severity_overrides("compliance: {}") == []
    for bad in (text.replace("high", "High"), text.replace("rule_id: R, ", "")):
        with pytest.raises(ValueError):
            rules.severity_overrides(bad)


def test_folders(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("cpe/by-purl/pkg%3Anpm%2FExpress%404.json", '{"vendor": "e", "product": "x"}')
    put("cpe/by-purl/pkg%3Anpm%2Fbad.json", "{cut")
    put("cpe/by-purl/pkg%3Anpm%2Fc%2Bd.json", '{"vendor": "c", "product": "d"}')
    put("cpe/by-name/npm/lib.json", '{"vendor": "l", "product": "lib"}')
    put("fingerprint/sha256/AB.json", '{"Name": "n", "version": "1"}')
    exact, skipped = folders.cpe_names(spark, str(tmp_path))
    named, none = folders.cpe_names(spark, str(tmp_path), "name")
    assert {tuple(r) for r in exact.collect()} == {("pkg:npm/express@4", "e", "x"), ("pkg:npm/c+d", "c", "d")}
    assert [r.name for r in skipped.collect()] == ["pkg:npm/bad"] and none.collect() == []
    c = spark.createDataFrame([("a", "pkg:npm/express@4", "npm|express"), ("b", "pkg:npm/lib@2", "npm|lib"), ("c", "", "")], "bom_ref string, key string, type_name string")
    assert {tuple(r) for r in folders.resolved(c, exact, named).collect()} == {("a", "e", "x"), ("b", "l", "lib")}
    assert [tuple(r) for r in folders.fingerprints(spark, str(tmp_path)).collect()] == [("sha256", "ab", "n", "1", "")]
    put("fingerprint/sha256/cd.json", "cut")
    with pytest.raises(Exception, match="not a fingerprint"):
        folders.fingerprints(spark, str(tmp_path)).collect()


def test_registries(spark):
    import base64
    import json

    from bomlake.sources import registries

    def rows(*payloads):
        return spark.createDataFrame([(str(i), p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)] + [("n", None)], "purl_key string, text string")

    npm = registries.npm(rows(
        {"description": "d", "license": "MIT", "author": "A B <a@b> (http://x)", "repository": {"url": "git+https://h/r.git"}, "bugs": "http://b", "dist": {"shasum": "00", "integrity": "sha512-" + base64.b64encode(b"ab").decode()}},
        {"license": {"type": "(MIT OR ISC)"}, "author": {"name": "C"}, "repository": "https://h/r.git#x", "bugs": {"url": "u"}},
        {"licenses": [{"type": "BSD"}, {"type": "UNLICENSED"}], "maintainers": [{"name": "M"}], "dist": {"integrity": "md5-xx"}},
        "cut", "[]",
    )).collect()
    got = {r.purl_key: (r.author, r.supplier, r.repository, r.bugs, [tuple(x) for x in r.licences], [tuple(x) for x in r.hashes]) for r in npm}
    assert got == {
        "0": ("A B", "A B", "https://h/r", "http://b", [("MIT", "MIT")], [("sha1", "00"), ("sha512", "6162")]),
        "1": ("C", "C", "https://h/r.git#x", "u", [("", "MIT OR ISC")], []),
        "2": ("", "M", "", "", [("BSD", "BSD")], []),
    }
    pypi = registries.pypi(rows(
        {"info": {"summary": "s", "license_expression": "MIT", "license": "no", "author": "A", "home_page": "", "project_url": "p", "project_urls": {"Source": "r.git", "Issues": "i", "Docs": "d"}}, "urls": [{"digests": {"SHA256": "1", "md5": ""}}, {"digests": {"sha256": "2", "md5": "3"}}]},
        {"info": {"description": "t", "classifiers": ["x", "License :: OSI Approved :: ISC License (ISCL)"], "maintainer": "M", "project_urls": None}},
    )).collect()
    assert {r.purl_key: (r.description, r.author, r.homepage, r.repository, r.bugs, r.docs, [tuple(x) for x in r.licences], [tuple(x) for x in r.hashes]) for r in pypi} == {"0": ("s", "A", "p", "r", "i", "d", [("MIT", "MIT")], [("sha256", "1"), ("md5", "3")]), "1": ("t", "M", "", "", "", "", [("ISC", "ISC")], [])}
