"""Archives, binaries, XML and tag-value documents, and operators on their rows."""

import gzip
import hashlib
import io
import json
import struct
import tarfile
import zipfile
import zlib

from bomlake.functions import binaries, manifests
from bomlake.operators import builds, exposition, images, merging, search, validators
from bomlake.sources import archives, documents
from pyspark.sql import functions as F


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            if body is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(body)
            t.addfile(info, io.BytesIO(body or b""))
    return out.getvalue()


LAYERS = [tar([("./etc", None), ("./etc/a", b"1"), ("etc/b", b"22"), ("opt/x", b"333"), ("", None)]), tar([("etc/.wh.a", b""), ("opt/.wh..wh..opq", b""), ("opt/y", b"4")])]
WANTED = [(0, "add", "etc/a", 1), (0, "add", "etc/b", 2), (0, "add", "opt/x", 3), (1, "wh", "etc/a", 0), (1, "opq", "opt", 0), (1, "add", "opt/y", 1)]


def test_layers(spark):
    """Plain and compressed layers; folded, what whiteouts and opaque folders hide is gone."""
    rows = spark.createDataFrame([("i", 0, bytearray(gzip.compress(LAYERS[0]))), ("i", 1, bytearray(LAYERS[1]))], "image string, layer int, content binary")
    entries = archives.layer_entries(rows, 2)
    assert sorted((r.layer, r.seq, r.op, r.path, r.size) for r in entries.collect()) == sorted((layer, seq, op, path, size) for (layer, op, path, size), seq in zip(WANTED, [1, 2, 3, 0, 1, 2]))
    assert {r.path: r.body for r in entries.filter("op = 'add'").collect()} == {"etc/a": b"1", "etc/b": b"22", "opt/x": None, "opt/y": b"4"}
    assert {(r.path, r.layer) for r in images.effective(entries).collect()} == {("etc/b", 0), ("opt/y", 1)}
    assert archives.layer_entries(rows.limit(0)).collect() == []


def test_saved_image_and_layout(spark, tmp_path):
    manifest = json.dumps([{"Layers": ["1/layer.tar", "0/layer.tar"]}]).encode()
    (tmp_path / "image.tar").write_bytes(tar([("0/layer.tar", LAYERS[1]), ("1/layer.tar", LAYERS[0]), ("manifest.json", manifest)]))
    saved = archives.saved_images(spark, str(tmp_path / "image.tar"))
    assert [(r.layer, r.digest, bytes(r.content) == LAYERS[r.layer]) for r in saved.orderBy("layer").collect()] == [(0, "1/layer.tar", True), (1, "0/layer.tar", True)]

    blobs = tmp_path / "layout" / "blobs" / "sha256"
    blobs.mkdir(parents=True)

    def put(body):
        digest = hashlib.sha256(body).hexdigest()
        (blobs / digest).write_bytes(body)
        return f"sha256:{digest}"

    right = put(json.dumps({"layers": [{"digest": put(b)} for b in LAYERS]}).encode())
    wrong = put(json.dumps({"layers": []}).encode())
    index = {"manifests": [{"digest": wrong, "platform": {"os": "linux", "architecture": "arm64"}}, {"digest": right, "platform": {"os": "linux", "architecture": "amd64"}}]}
    nested = put(json.dumps(index).encode())
    (tmp_path / "layout" / "index.json").write_text(json.dumps({"manifests": [{"digest": nested}]}))
    found = archives.layout_layers(spark, str(tmp_path / "layout"))
    assert [bytes(r.content) for r in found.orderBy("layer").collect()] == LAYERS


def elf(sections):
    """A little-endian 64-bit ELF file with these sections."""
    names, body, table = b"\0", b"\x7fELF\2\1\1".ljust(64, b"\0"), [b"\0" * 64]
    for name, data in [*sections.items(), (".shstrtab", None)]:
        at, names = len(names), names + name.encode() + b"\0"
        data = names if data is None else data
        table.append(struct.pack("<IIQQQQIIQQ", at, 1, 0, 0, len(body), len(data), 0, 0, 0, 0))
        body += data
    head = bytearray(body)
    struct.pack_into("<Q", head, 40, len(body))
    struct.pack_into("<HHH", head, 58, 64, len(table), len(table) - 1)
    return bytes(head) + b"".join(table)


def jar(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def go(path, version):
    info = b"x" * 16 + f"path\t{path}\nmod\t{path}\t{version}\th1:\ndep\tx.org/d\tv2\th1:\n".encode() + b"y" * 16
    return b"\x7fELFjunk" + binaries.GO_MARK + bytes([8, 2]) + b"\0" * 16 + bytes([8]) + b"go1.22.1" + bytes([len(info) & 127 | 128, len(info) >> 7]) + info


def test_identities(spark):
    audit = zlib.compress(json.dumps({"packages": [{"name": "dep", "version": "2"}, {"name": "tool", "version": "1", "root": True}]}).encode())
    cases = {
        "bin/g": (go("x.org/m", "v1.2"), ("go", "x.org/m", "v1.2", "pkg:golang/x.org/m@v1.2", ["pkg:golang/x.org/d@v2"])),
        "bin/g0": (go("x.org/m", ""), ("go", "x.org/m", "", "pkg:golang/x.org/m@unknown", ["pkg:golang/x.org/d@v2"])),
        "bin/r": (elf({".dep-v0": audit}), ("rust", "tool", "1", "pkg:cargo/tool@1", ["pkg:cargo/dep@2"])),
        "a.jar": (jar({"META-INF/maven/g/a/pom.properties": "#c\ngroupId = g\nartifactId=a\nversion:1\n"}), ("java", "a", "1", "pkg:maven/g/a@1", [])),
        "b.jar": (jar({"META-INF/MANIFEST.MF": "Bundle-SymbolicName: org.\r\n b;singleton\r\nBundle-Version: 2\r\n"}), ("java", "org.b", "2", "pkg:maven/org.b@2", [])),
        "lib/c-d-3.1-beta.jar": (jar({"x": ""}), ("java", "c-d", "3.1-beta", "pkg:maven/c-d@3.1-beta", [])),
        "p/x-1.dist-info/METADATA": (b"Name: x\nVersion: 1\nSummary: a\n b\nName: y\n\nVersion: 9\n", ("python", "x", "1", "pkg:pypi/x@1", [])),
        "w/Tool-1.2.exe": (b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0", ("pe", "Tool", "1.2", "pkg:nuget/Tool@1.2", [])),
        "lib/z": (elf({".dynstr": b"\0libfoo.so.3\0", ".dynamic": struct.pack("<QQQQ", 1, 0, 14, 1), ".rodata": b"about\0v4.5.6\0"}), ("elf", "foo", "4.5.6", "pkg:generic/foo@4.5.6", [])),
        "lib/libbar.so.1": (elf({".note.gnu.build-id": b"\0" * 16 + b"id"}), ("elf", "bar", "", "pkg:generic/bar", [])),
    }
    nothing = {"e": b"", "x/METADATA": b"Name: x\n", "t.jar": b"PK\x03\x04cut", "cut": cases["lib/z"][0][:100], "odd": elf({".text": b""}), "a.exe": b"MZ", "cutgo": cases["bin/g"][0][:45], "n": None}
    rows = [("i", k, bytearray(v[0])) for k, v in cases.items()] + [("i", k, v if v is None else bytearray(v)) for k, v in nothing.items()]
    found = binaries.identified(spark.createDataFrame(rows, "image string, path string, body binary")).collect()
    assert {r.path: (r.kind, r.name, r.version, r.purl, r.dependencies) for r in found} == {k: v[1] for k, v in cases.items()}


XML = """<?xml version="1.0"?><bom xmlns="http://cyclonedx.org/schema/bom/1.6"><components><component type="application" bom-ref="a"><name>app</name><version>1</version><supplier><name>s</name></supplier>
<components><component type="library" bom-ref="b"><name>lib</name><purl>pkg:npm/lib@2</purl></component></components></component></components>
<dependencies><dependency ref="a"><dependency ref="b"/></dependency><dependency ref="b"/></dependencies></bom>"""
TAGS = """SPDXVersion: SPDX-2.3
DocumentName: d

PackageName: app
SPDXID: SPDXRef-a
PackageVersion: 1
PackageSupplier: Organization: Acme
Relationship: SPDXRef-DOCUMENT DESCRIBES SPDXRef-a
Relationship: SPDXRef-a CONTAINS SPDXRef-b
Relationship: SPDXRef-b DEPENDS_ON SPDXRef-a
Relationship: SPDXRef-b OTHER SPDXRef-a

PackageName: lib
SPDXID: SPDXRef-b
ExternalRef: PACKAGE-MANAGER purl pkg:npm/lib@2
"""


def test_xml_and_tag_value(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.spdx").write_text(TAGS)
    (tmp_path / "c.spdx").write_text("SPDXVersion: SPDX-2.3\n")
    docs = documents.read(spark, str(tmp_path))
    assert sorted(r.format for r in docs.collect()) == ["cyclonedx-xml", "spdx-tag-value", "spdx-tag-value"]
    rows = documents.cyclonedx_xml_components(docs).collect()
    assert {(r.bom_ref, r.parent, r.depth, r.ctype, r.name, r.version, r.purl, r.supplier) for r in rows} == {("a", None, 0, "application", "app", "1", "", "s"), ("b", "a", 1, "library", "lib", "", "pkg:npm/lib@2", "")}
    assert [(r.src, r.dst) for r in documents.cyclonedx_xml_edges(docs).collect()] == [("a", "b")]
    parts, edges = documents.tag_value_components(docs), documents.tag_value_edges(docs)
    assert {(r.bom_ref, r.name, r.version, r.purl, r.supplier) for r in parts.collect()} == {("SPDXRef-a", "app", "1", "", "Acme"), ("SPDXRef-b", "lib", "", "pkg:npm/lib@2", "")}
    nested, rest = documents.nested_by_containment(parts, edges)
    assert {(r.bom_ref, r.parent) for r in nested.collect()} == {("SPDXRef-a", None), ("SPDXRef-b", "SPDXRef-a")}
    assert sorted((r.src, r.dst, r.rel) for r in rest.collect()) == [("SPDXRef-b", "SPDXRef-a", "depends-on"), ("SPDXRef-b", "SPDXRef-a", "unknown")]


def test_runtimes(spark):
    h = lambda by="", author="", comment="", empty=False: (by, author, comment, empty)
    cases = [
        ("docker", "", {}, {}, [], ["d"], [h("RUN x")]),
        ("docker", None, None, None, None, None, None),
        ("buildkit", "Kaniko", {}, {"vnd.docker.reference.type": "attestation-manifest"}, [], ["d"], []),
        ("buildkit", "", {"moby.buildkit.a": "1"}, {}, [], ["d"], []),
        ("buildkit", "", {}, {}, [], ["d"], [h("x"), h("# buildkit.dockerfile.v0")]),
        ("kaniko", "Kaniko", {"jib.image.x": ""}, {}, [], ["d"], []),
        ("kaniko", "", {"org.opencontainers.image.builder": "a KANIKO"}, {}, [], ["d"], []),
        ("kaniko", "", {}, {}, [], ["d"], [h("RUN x")] * 5),
        ("jib", "", {"com.google.cloud.tools.jib.v": ""}, {}, [], ["d"], []),
        ("jib", "", {}, {}, [], ["d"] * 3, [h("jib-classes"), h(comment="jib-resources")]),
        ("ko", "", {"org.opencontainers.image.source": "s"}, {}, ["/ko-app/a"], ["d"], []),
        ("docker", "", {"org.opencontainers.image.source": "s"}, {}, ["/app"], ["d"], []),
        ("buildah", "", {}, {}, [], ["d"], [h("x"), h("y", "Buildah"), h("podman: z")]),
        ("podman", "", {}, {}, [], ["d"], [h("containers-storage: RUN x"), h("buildah: y")]),
    ]
    kind = f"image int, want string, author string, labels map<string,string>, annotations map<string,string>, entrypoint array<string>, layers array<string>, history {builds.HISTORY.replace(':', ' ', 0)}"
    found = builds.detected(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], kind))
    assert [r.runtime for r in found.orderBy("image").collect()] == [c[0] for c in cases]
    aligned = builds.aligned(found.filter("image in (0, 13)")).orderBy("image", "layer").collect()
    assert [(r.image, r.created_by, r.instruction) for r in aligned] == [(0, "RUN x", "RUN"), (13, "RUN x", "RUN")]
    texts = {"/bin/sh -c #(nop)  COPY a b": "COPY", "/bin/sh -c #(nop) CMD x": "UNKNOWN", "run make": "RUN", "RUNTIME": "UNKNOWN", "/bin/bash -c ls": "RUN", "": "UNKNOWN", " ENV A=1": "ENV", "a": "UNKNOWN"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", builds.instruction(F.col("t")).alias("i"))
    assert {r.t: r.i for r in df.collect()} == texts


def test_merging(spark):
    rows = spark.createDataFrame([("k", 1, 0, {"a": "1"}), ("k", 2, None, {"a": "2", "b": "x"}), ("k", 3, 4, {"a": "3", "b": "x"}), ("l", 1, None, {"a": "1"})], "key string, rank int, layer int, props map<string,string>")
    assert {(r.key, r.name, r.value) for r in merging.properties(rows).collect()} == {("k", "a", "1"), ("k", "conflict:a", "3"), ("k", "b", "x"), ("l", "a", "1")}
    assert {(r.key, r.layer, r.also_in_layer, r.merged) for r in merging.other_layer(rows).collect()} == {("k", 0, 4, 2), ("l", None, None, 0)}
    lists = spark.createDataFrame([("k", 2, ["X", "y"]), ("k", 1, ["x", "", "x"]), ("l", 1, [])], "key string, rank int, cpes array<string>")
    assert {(r.key, r.item, r.rank) for r in merging.union(lists, "cpes", F.lower("item")).collect()} == {("k", "x", 1), ("k", "y", 2)}


def test_nested_files(spark):
    rows = spark.createDataFrame([("s", "/0", "file"), ("s", "/0/1", "library"), ("s", "/1", "library"), ("s", "/1/0", "file"), ("t", "/0", "library")], "sbom_id string, place string, ctype string")
    assert {(r.sbom_id, r.place) for r in validators.outside_files(rows).collect()} == {("s", "/1"), ("t", "/0")}


def test_exposition(spark):
    numbers = {0.0: "0", 1.0: "1", 100.0: "100", 0.25: "0.25", 1234567.5: "1234567.5", 1e10: "10000000000", 0.0001: "0.0001", 1e-7: "1e-07", -2.5: "-2.5", 1.5e30: "1.5e+30"}
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", exposition.number(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == numbers
    pair = exposition.labels({"b": F.lit('q"\\'), "a": F.lit(None).cast("string")})
    assert spark.range(1).select(pair.alias("p")).head().p == '{a="",b="q\\\\\\"\\\\\\\\"}'
    assert exposition.header("m", "counter", "a\nb") == ["# HELP m a\\nb", "# TYPE m counter"]


def test_manifests(spark):
    cases = {
        "a/package.json": ('{"name": "@s/n", "version": "1"}', ("a", "npm", "@s/n", "1", "pkg:npm/@s/n@1")),
        "b/Cargo.toml": ('[dependencies]\nname = "no"\n[package]\nversion = "2"\nname = \'c\'\n[lib]\nname = "l"\n', ("b", "cargo", "c", "2", "pkg:cargo/c@2")),
        "go.mod": ("// x\nmodule x.org/m\n", ("", "golang", "x.org/m", "", "pkg:golang/x.org/m@unknown")),
        "p/pom.xml": ('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId><version>3</version></parent><artifactId>a</artifactId></project>', ("p", "maven", "g:a", "3", "pkg:maven/g/a@3")),
        "y/pyproject.toml": ('[tool.poetry]\nname = "y"\n', ("y", "pypi", "y", "", "pkg:pypi/y")),
        "s/z-1.dist-info/METADATA": ("Name: z\nVersion: 1\n\nName: no\n", ("s", "pypi", "z", "1", "pkg:pypi/z@1")),
        "composer.json": ('{"name": "v/p"}', ("", "composer", "v/p", "", "pkg:composer/v/p")),
        "h/Chart.yaml": ('apiVersion: v2\nname: "h"\nversion: 0.1.0 # x\n', ("h", "helm", "h", "0.1.0", "pkg:helm/h@0.1.0")),
        "r/x.gemspec": ("Gem::Specification.new do |s|\n  s.name = 'r'\n  s.version = Gem::Version.new(\"5\")\n", ("r", "gem", "r", "5", "pkg:gem/r@5")),
    }
    nothing = {"c/composer.json": '{"name": "plain"}', "package.json": "{cut", "q/pom.xml": "<project>", "README": "x", "METADATA": "Name: x\n", "n/go.mod": None, "e/Cargo.toml": ""}
    rows = [(k, v[0]) for k, v in cases.items()] + list(nothing.items())
    found = manifests.roots(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {r.path: (r.root, r.kind, r.name, r.version, r.purl) for r in found} == {k: v[1] for k, v in cases.items()}


def test_search(spark):
    names = ["cpe:2.3:a:acme:lib:1.0:*:*:*:*:*:*:*", "cpe:2.3:a:lib:lib:*:*:*:*:*:*:*:*", "cpe:2.3:h:lib:lib:*:*:*:*:*:*:*:*", "cpe:2.3:a:other:lib:2.0:*:*:*:*:*:*:*", "cpe:2.3:a:other:lib_x:-:*:*:*:*:*:*:*", "bad:lib"]
    c = spark.createDataFrame([("a", "pkg:npm/acme/lib@1.0"), ("b", "pkg:npm/none@1"), ("c", "")], "bom_ref string, purl string")
    found = search.searched(c, spark.createDataFrame([(n,) for n in names], "cpe string")).collect()
    assert {(r.bom_ref, r.cpe.split(":", 2)[2][:11], str(r.score), r.rejected) for r in found} == {("a", "a:acme:lib:", "1.00", ""), ("a", "a:lib:lib:*", "1.00", ""), ("a", "h:lib:lib:*", "0.05", "hardware"), ("a", "a:other:lib", "0.20", "weak")}


def test_provenance(spark):
    text = {"_type": "t", "predicateType": builds.PREDICATES[0], "predicate": {"buildType": "b", "builder": {"id": "https://x/y@v1.2"}, "materials": [{"uri": "u", "digest": {"sha256": "d"}}]}}
    rows = spark.createDataFrame([("i", json.dumps(text)), ("j", json.dumps({**text, "predicateType": "other"})), ("k", "{}"), ("l", "cut{"), ("m", None)], "image string, text string")
    got = {r.image: (r.predicate, r.build_type, r.builder_version, r.started, r.materials and r.materials[0].uri) for r in builds.provenance(rows).collect()}
    assert got == {"i": (builds.PREDICATES[0], "b", "v1.2", "", "u"), "j": ("other", "", "", "", None)}
    kind = "pos int, digest string, annotations map<string,string>"
    note = {"vnd.docker.reference.type": "attestation-manifest", "vnd.docker.reference.digest": "sha256:1"}
    manifests_ = spark.createDataFrame([(0, "a", {}), (2, "c", note), (1, "b", note), (3, "d", None)], kind)
    images_ = spark.createDataFrame([("i", "sha256:1"), ("j", "sha256:2")], "image string, digest string")
    assert [tuple(r) for r in builds.attestations(manifests_, images_).collect()] == [("i", "b")]


def test_components_of_every_depth(spark):
    from bomlake.sources import documents

    inner, xml = "", ""
    for k in reversed(range(12)):
        inner = f'{{"bom-ref":"c{k}","type":"library","name":"n{k}"' + (f',"components":[{inner}]' if inner else "") + "}"
        xml = f'<component bom-ref="c{k}" type="library"><name>n{k}</name>' + (f"<components>{xml}</components>" if xml else "<components/>") + "</component>"
    texts = [("j", "cyclonedx-json", f'{{"bomFormat":"CycloneDX","components":[{inner}]}}'), ("x", "cyclonedx-xml", f'<bom xmlns="http://cyclonedx.org/schema/bom/1.5"><!-- </components> --><components>{xml}</components></bom>')]
    docs = spark.createDataFrame(texts, "sbom_id string, format string, text string")
    want = [(k, f"c{k}", f"c{k - 1}" if k else None) for k in range(12)]
    for read in (documents.cyclonedx_components, documents.cyclonedx_xml_components):
        assert sorted((r.depth, r.bom_ref, r.parent) for r in read(docs).collect()) == want
