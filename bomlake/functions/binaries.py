"""Names and versions that files carry: (path, body) -> identities.

Each reader gives (kind, confidence, name, version, purl, dependencies) or None; files that are cut off or
damaged give nothing. Of all that a file gives the most confident is kept, the earlier reader on a tie.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes read of what is packed within a file, and of data searched for a version (fixed values).
PACKED, SEARCHED = 16 << 20, 1 << 20
#: Endings of files whose names state a release.
ARCHIVES, PROGRAMS = (".jar", ".war", ".ear"), (".exe", ".dll")
NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
GO_MARK = b"\xff Go buildinf:"


def purl(kind: str, name: str, version: str, namespace: str = "") -> str:
    """A package URL; Go modules without a version get @unknown."""
    version = version or ("unknown" if kind == "golang" else "")
    return f"pkg:{kind}/{namespace + '/' if namespace else ''}{name}{'@' + version if version else ''}"


def base_and_folder(path: str) -> tuple[str, str]:
    folder, _, base = path.rpartition("/")
    return base, folder


def headers(text: str) -> dict[str, str]:
    """Mail-like headers up to the first empty line; the first of equal names wins, indented lines go on."""
    block = re.sub(r"\n[ \t]+", " ", re.split(r"\n\r?\n", text.replace("\r\n", "\n"), maxsplit=1)[0])
    pairs = [line.split(":", 1) for line in block.split("\n") if ":" in line]
    return {k.strip(): v.strip() for k, v in reversed(pairs) if k.strip()}


def manifest_fields(text: str) -> dict[str, str]:
    """Fields of a JAR manifest; lines that start with a space go on without it, the last of equal names wins."""
    whole = text.replace("\r\n", "\n").replace("\n ", "")
    return {k.strip(): v.strip() for k, v in (line.split(":", 1) for line in whole.split("\n") if ":" in line)}


def property_fields(text: str) -> dict[str, str]:
    found = (re.fullmatch(r"\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*", line) for line in text.splitlines())
    return {m[1]: m[2] for m in found if m}


class Elf:
    """Sections of an ELF file by name."""

    def __init__(self, body: bytes):
        wide, order = body[4] == 2, "<" if body[5] == 1 else ">"
        self.order, self.wide, self.body = order, wide, body
        table, = struct.unpack_from(order + ("Q" if wide else "I"), body, 40 if wide else 32)
        size, count, names = struct.unpack_from(order + "HHH", body, 58 if wide else 46)
        form = order + ("IIQQQQ" if wide else "IIIIII")
        raw = [struct.unpack_from(form, body, table + i * size) for i in range(count)]
        text = self.cut(raw[names]) if count else b""
        self.sections = {text[r[0] : text.find(b"\0", r[0])].decode("latin-1"): r for r in raw}

    def cut(self, section) -> bytes:
        return b"" if section[1] == 8 else self.body[section[4] : section[4] + section[5]]

    def data(self, name: str) -> bytes:
        return self.cut(self.sections[name]) if name in self.sections else b""

    def soname(self) -> str:
        strings, entry = self.data(".dynstr"), 16 if self.wide else 8
        for tag, value in struct.iter_unpack(self.order + ("QQ" if self.wide else "II"), self.data(".dynamic")[: len(self.data(".dynamic")) // entry * entry]):
            if tag == 14:
                return strings[value : strings.find(b"\0", value)].decode("latin-1")
        return ""


def from_go(path: str, body: bytes):
    """Build information that the linker writes inline: two texts with their lengths, the second between marks of 16 bytes."""
    at = body.find(GO_MARK)
    if at < 0 or not body[at + 15] & 2:
        return None
    texts, at = [], at + 32
    for _ in range(2):
        size = shift = 0
        while True:
            byte = body[at]
            at, size, shift = at + 1, size | (byte & 127) << shift, shift + 7
            if byte < 128:
                break
        texts.append(body[at : at + size])
        at += size
    lines = [line.split("\t") for line in texts[1][16:-16].decode("utf-8", "replace").split("\n")]
    main = next((x for x in lines if x[0] == "mod" and len(x) > 2), None)
    if not main or main[1] in ("", "command-line-arguments"):
        return None
    return "go", 0.95, main[1], main[2], purl("golang", main[1], main[2]), [purl("golang", x[1], x[2]) for x in lines if x[0] == "dep" and len(x) > 2 and x[1]]


def from_rust(path: str, body: bytes):
    packed = Elf(body).data(".dep-v0") if body[:4] == b"\x7fELF" else b""
    if not packed:
        return None
    packages = json.loads(zlib.decompressobj().decompress(packed, PACKED))["packages"]
    root = next((p for p in packages if p.get("root")), None)
    if not root or not root.get("name"):
        return None
    return "rust", 0.95, root["name"], root.get("version", ""), purl("cargo", root["name"], root.get("version", "")), [purl("cargo", p["name"], p.get("version", "")) for p in packages if p is not root and p.get("name")]


def from_jar(path: str, body: bytes):
    """Maven's properties, else the manifest where it tells name and version, else the file's name."""
    if body[:4] != b"PK\x03\x04":
        return None

    def jar(name, version, group=""):
        return "java", 0.90, name, version, purl("maven", name, version, group), []

    archive = zipfile.ZipFile(io.BytesIO(body))

    def member(name):
        with archive.open(name) as f:
            return f.read(PACKED).decode("utf-8", "replace")

    for name in archive.namelist():
        if name.startswith("META-INF/maven/") and name.endswith("/pom.properties"):
            p = property_fields(member(name))
            if p.get("artifactId"):
                return jar(p["artifactId"], p.get("version", ""), p.get("groupId", ""))
    if "META-INF/MANIFEST.MF" in archive.namelist():
        m = manifest_fields(member("META-INF/MANIFEST.MF"))
        name = m.get("Bundle-SymbolicName", "").split(";")[0].strip() or m.get("Implementation-Title") or m.get("Bundle-Name")
        version = m.get("Bundle-Version") or m.get("Implementation-Version")
        if name and version:
            return jar(name, version, m.get("Implementation-Vendor", ""))
    named = release_of(base_and_folder(path)[0], ARCHIVES, "-")
    return jar(*named) if named else None


def release_of(base: str, endings: tuple[str, ...], marks: str, prefix: str = "") -> tuple[str, str] | None:
    """Name and version of a file that is called by both: the version starts at the first digit behind a mark."""
    ending = next((e for e in endings if base.endswith(e)), None)
    stem = base.removesuffix(ending) if ending else ""
    for i in range(1, len(stem) - 1):
        name, version = stem[:i], stem[i + 1 :].removeprefix(prefix)
        if stem[i] in marks and version[:1].isdigit():
            return (name, version) if NAME_LETTERS.issuperset(name + version) else None
    return None


def first_version(data: bytes) -> str:
    """The first token of a program's constants that reads as a version: two or three numbers, perhaps a suffix."""
    for token in re.finditer(rb"[0-9A-Za-z_.-]+", data):
        core, dash, suffix = token[0].decode().removeprefix("v").rstrip(".").partition("-")
        numbers = core.split(".")
        if 2 <= len(numbers) <= 3 and all(n.isdigit() for n in numbers):
            suffix = suffix.partition("_")[0].partition("-")[0].rstrip(".")
            return f"{core}-{suffix}" if suffix else core
    return ""


def from_wheel(path: str, body: bytes):
    base, folder = base_and_folder(path)
    if base != "METADATA" or not folder.endswith(".dist-info"):
        return None
    h = headers(body.decode("utf-8", "replace"))
    return ("python", 0.95, h["Name"], h.get("Version", ""), purl("pypi", h["Name"], h.get("Version", "")), []) if h.get("Name") else None


def from_pe(path: str, body: bytes):
    named = release_of(base_and_folder(path)[0], PROGRAMS, "-_ ", "v")
    if body[:2] != b"MZ" or not named or body[(at := struct.unpack_from("<I", body, 60)[0]) : at + 4] != b"PE\0\0":
        return None
    return "pe", 0.60, *named, purl("nuget", *named), []


def from_elf(path: str, body: bytes):
    """The library's own name, else the file's, if the file has a name, a build id or a version at all."""
    if body[:4] != b"\x7fELF":
        return None
    elf = Elf(body)
    soname, number = elf.soname(), first_version(elf.data(".rodata")[:SEARCHED])
    if not soname and not elf.data(".note.gnu.build-id")[16:] and not number:
        return None
    plain = lambda x: re.sub(r"(?s)(?<=.)\.so.*", "", x, count=1).removeprefix("lib")
    name = plain(soname) or plain(base_and_folder(path)[0])
    return ("elf", 0.60, name, number, purl("generic", name, number), []) if name else None


READERS = [from_go, from_rust, from_jar, from_wheel, from_pe, from_elf]


def identity(path: str, body: bytes):
    """The most confident identity of a file, or None."""
    found = []
    for reader in READERS:
        try:
            found.append(reader(path, body))
        except (struct.error, IndexError, KeyError, TypeError, ValueError, zlib.error, zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError):
            continue  # not a whole file of this kind
    return max(filter(None, found), key=lambda x: x[1], default=None)


def identified(files: DataFrame) -> DataFrame:
    """(image, path, body) -> image, path, kind, confidence, name, version, purl, dependencies of files that tell."""
    names = ["image", "path", "kind", "confidence", "name", "version", "purl", "dependencies"]
    kinds = [pa.string()] * 3 + [pa.float64()] + [pa.string()] * 3 + [pa.list_(pa.string())]

    def work(batches):
        for batch in batches:
            rows = []
            for image, path, body in zip(*batch.columns):
                if found := identity(path.as_py(), body.as_py()):
                    rows.append((image.as_py(), path.as_py(), *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    kept = files.filter("path is not null and body is not null").select(F.col("image").cast("string"), "path", "body")
    return kept.mapInArrow(work, "image string, path string, kind string, confidence double, name string, version string, purl string, dependencies array<string>")
