"""The scan's claims against a sequential version, on random trees with nested and overlapping roots."""

import posixpath
import random
import re

import pytest
from bomlake.operators import claims, images
from pyspark.sql import functions as F

NAMES = ["Makefile", "configure", "README.md", "LICENSE", "src", "include", "test", "a", "b", "lib-1.2", "x_3", "package.json", "f.so", "g.c", "tool-v2"]


def tree(r):
    paths = {"/".join(r.choice(NAMES[4:11] + ["opt", "usr"]) for _ in range(r.randrange(4))) for _ in range(25)}
    files = {f"{p}/{r.choice(NAMES)}".strip("/") for p in paths for _ in range(r.randrange(1, 9))}
    return sorted(f for f in files if not any(g.startswith(f + "/") for g in files))


def within(path, root):
    return bool(root) and (path == root or path.startswith(root + "/"))


def sequential(files, anchors, known):
    """Clusters and components as one walk after the other finds them."""
    found = [dict(a, files=[]) for a in sorted(anchors, key=lambda a: -(a["root"].count("/") + 1 if a["root"] else 0))]
    free = []
    for f in files:
        for c in found:
            if within(f, c["root"]):
                c["files"].append(f)
                break
        else:
            free.append(f)
    dirs = {}
    for f in files:
        parts = f.split("/")
        for n in range(1, len(parts)):
            d = dirs.setdefault("/".join(parts[:n]), [set(), 0, False])
            d[0].add(parts[n])
            d[1] += 1
            d[2] |= f not in free
    scored = set()
    for name in sorted(dirs):
        children, n, claimed = dirs[name]
        ups = [name.rsplit("/", i)[0] for i in range(name.count("/") + 1)]
        if len(children) < 3 or claimed or scored & set(ups):
            continue
        own = name.rsplit("/", 1)[-1]
        stated = next((m.groups() for m in (re.match(p, own) for p in images.NAME_FORMS) if m), ("", ""))
        low = {c.lower() for c in children}
        score = 5 * ("Makefile" in children and "configure" in children) + 5 * bool(stated[1]) + 3 * ({"src", "include"} <= low) + 2 * bool(low & {"test", "tests", "spec"}) + 2 * ("license" in low and any(x.startswith("readme") for x in low)) + (n > 100) + 2 * (n > 1000)
        if score < 7:
            continue
        scored |= set(ups)
        title = stated[0] or own
        found.append({"root": name, "name": title, "purl": f"pkg:generic/{title}{'@' + stated[1] if stated[1] else ''}?root=/{name}", "files": [f for f in files if within(f, name) and f in free]})
    keys, coords = {p.split("?")[0] for p in known if p}, {p[4:].split("?")[0].split("@")[0] for p in known if p.startswith("pkg:")} - {""}
    components = []
    for c in found:
        key = c["purl"].split("?")[0]
        coord = key[4:].split("@")[0] if key.startswith("pkg:") else ""
        if c["name"] and key not in keys and coord not in coords:
            components.append(c["root"])
            keys.add(key)
    return found, components


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_a_sequential_version(spark, seed):
    r = random.Random(seed)
    all_files = []
    for image in range(12):
        files = [f"img{image}{p and '-'}{p}".replace("-", "/", 1) for p in tree(r)]
        files = sorted({f.replace(f"img{image}/", f"i{image}t/", 1) for f in files})
        all_files += files
    anchors = []
    for n, f in enumerate(f for f in all_files if f.endswith("/package.json") and r.random() < 0.5):
        name = r.choice(["", "p", "q", "s"])
        anchors.append({"ord": n, "path": f, "root": posixpath.dirname(f), "name": name, "purl": f"pkg:npm/{name}{r.choice(['', '@1', '@2'])}?root=x" if name else ""})
    known = ["pkg:npm/q@9?y", "pkg:generic/lib@1.2", "", "nothing"]
    found, components = sequential(all_files, anchors, known)
    files = spark.createDataFrame([(f, 1) for f in all_files], "path string, size long").repartition(4)
    table = spark.createDataFrame([(a["ord"], a["path"], a["root"], "npm", a["name"], "", a["purl"], 0.95, "m") for a in anchors], "ord long, path string, root string, kind string, name string, version string, purl string, confidence double, method string")
    got = claims.clusters(files, table)
    assert sorted((x.root, x.name, x.purl, x.n_files) for x in got.collect()) == sorted((c["root"], c["name"], c["purl"], len(c["files"])) for c in found)
    new = claims.unknown_clusters(got, spark.createDataFrame([(p,) for p in known], "purl string"))
    assert sorted(x.root for x in new.collect()) == sorted(components)


def test_redundant_against_a_plain_version(spark):
    r = random.Random(4)
    files = sorted({p for _ in range(20) for p in tree(r)})
    known = [*r.sample(files, 5), "/" + files[3], "./" + files[7], "opt/a/package.json", "package.json", "usr/x.gemspec", None]
    plain = [re.sub("^/", "", re.sub(r"^\./", "", k)) for k in known if k]
    folders = [posixpath.dirname(k) for k in plain if "/" in k and (posixpath.basename(k) in claims.MANIFESTS or k.endswith(".gemspec"))]
    want = [f for f in files if f in plain or any(within(f, d) for d in folders)]
    got = claims.redundant(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(k,) for k in known], "path string"))
    assert sorted(x.path for x in got.collect()) == want and 5 < len(want) < len(files)


def matched(pattern, path):
    """A glob by trying every way."""
    if not pattern:
        return not path
    c, rest = pattern[0], pattern[1:]
    if c == "*":
        return matched(rest, path) or bool(path) and path[0] != "/" and matched(pattern, path[1:])
    if not path:
        return False
    if c == "?":
        return path[0] != "/" and matched(rest, path[1:])
    if c == "[":
        end = rest.index("]", 2 if rest[0] == "^" else 1)
        body, hit = rest[rest[0] == "^" : end], False
        while body:
            if body[1:2] == "-":
                hit |= body[0] <= path[0] <= body[2]
                body = body[3:]
            else:
                hit |= body[0] == path[0]
                body = body[1:]
        return hit != (rest[0] == "^") and matched(rest[end + 1 :], path[1:])
    if c == "\\":
        c, rest = rest[0], rest[1:]
    return c == path[0] and matched(rest, path[1:])


def test_globs_against_a_plain_matcher(spark):
    r = random.Random(6)
    parts = ["*", "?", "[a-c]", "[^a]", "[b.]", "[c-a]", "a", "b", "/", ".", "\\*", "\\\\", "+", "("]
    globs = ["".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(60)]
    paths = ["".join(r.choice("abc/.*\\+(\n") for _ in range(r.randrange(7))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").distinct()
    rows = df.select("path", *[F.col("path").rlike(images.glob_pattern(g)).alias(f"g{i}") for i, g in enumerate(globs)]).collect()
    assert all(row[f"g{i}"] == matched(g, row.path) for row in rows for i, g in enumerate(globs)) and any(row[f"g{i}"] for row in rows for i in range(60))
    for broken in ("[", "[]a]", "[a", "a\\", "[a-]", "[-a]", "[^]"):
        with pytest.raises(ValueError):
            images.glob_pattern(broken)


def test_names_of_directories(spark):
    names = {
        "sqlite-version-3.44.0": ("sqlite", "3.44.0"), "bootstrap-5.3.2": ("bootstrap", "5.3.2"), "linux_4.19.0": ("linux", "4.19.0"), "yq-v4.40.5": ("yq", "4.40.5"), "rust-1.75.0-beta": ("rust", "1.75.0-beta"),
        "jq-1.7": ("jq", "1.7"), "foo-7": ("foo", "7"), "tool2_v2.3": ("", ""), "random-folder": ("", ""), "etc": ("", ""), "node_modules": ("", ""), "3.44.0": ("", ""),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    name, version = images.named_version(F.col("n"))
    assert {r.n: (r.a, r.b) for r in df.select("n", name.alias("a"), version.alias("b")).collect()} == names


def test_decisions_of_nothing_and_observed_counters(spark):
    from pyspark.sql import Observation

    files = spark.createDataFrame([(1, "a/package.json", bytearray(b"x"), 9), (2, "b/c", bytearray(b"#!"), 9), (3, "b/README", None, 1), (4, "d/x.so", None, 5000)], "ord long, path string, head binary, size long")
    roots, known = spark.createDataFrame([("a",), ("",)], "root string"), spark.createDataFrame([("/d/x.so",)], "path string")
    told = claims.decided(files, roots, known)
    seen = Observation()
    rows = {r.ord: r.decision for r in told.observe(seen, *claims.counters(told)).collect()}
    assert rows == {1: "cluster", 2: "added", 3: "noise", 4: "redundant"}
    assert seen.get == {"scanned": 4, "added": 1, "redundant": 1, "noise": 1, "by_classifier": 0, "by_rule": 0, "by_cluster": 1}
    assert claims.decided(files.limit(0), roots.limit(0), known.limit(0)).count() == 0
    digests = claims.decided(files.withColumn("digest", F.sha2("path", 256)), roots, known.limit(0), include_noise=True)
    assert {(r.ord, r.ctype, r.bypass) for r in claims.components(digests).collect()} == {(2, "application", ""), (3, "file", "noise"), (4, "library", "")}
