"""Identities that manifests state, as Column expressions: what a directory of unclaimed files is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import paths as P
from bomlake.functions.identifiers import blank

QUOTED = r"""['"]([^'"]+)['"]"""
POM = "groupId string, artifactId string, version string, parent struct<groupId:string,artifactId:string,version:string>"


def toml(text: Column, section: str, key: str) -> Column:
    """A quoted value of a section, '' where there is none."""
    block = F.regexp_extract(text, rf"(?ms)^\s*\[\s*{section}\s*\]\s*$(.*?)(?=^\s*\[[^\]]+\]\s*$|\z)", 1)
    return F.regexp_extract(block, rf"(?m)^\s*{key}\s*=\s*{QUOTED}", 1)


def stated(kind: str, name: Column, version: Column, path: Column | None = None) -> Column:
    """struct(kind, name, version, purl); null without a name."""
    at = F.when(version != "", F.concat(F.lit("@"), version)).otherwise("@unknown" if kind == "golang" else "")
    whole = F.struct(F.lit(kind).alias("kind"), name.alias("name"), version.alias("version"), F.concat(F.lit(f"pkg:{kind}/"), name if path is None else path, at).alias("purl"))
    return F.when(name != "", whole)


def from_json(kind: str, text: Column) -> Column:
    name, version = blank(F.get_json_object(text, "$.name")), blank(F.get_json_object(text, "$.version"))
    return stated(kind, F.when(name.contains("/"), name).otherwise("") if kind == "composer" else name, version)


def from_pom(text: Column) -> Column:
    """Group, artifact and version, each from the parent where the project has none."""
    pom = F.from_xml(text, POM, {"ignoreNamespace": "true"})
    field = lambda x: F.coalesce(*[F.when(c != "", c) for c in (F.trim(pom[x]), F.trim(pom["parent"][x]))], F.lit(""))
    group, artifact = field("groupId"), field("artifactId")
    whole = (group != "") & (artifact != "")
    return stated("maven", F.when(whole, F.concat_ws(":", group, artifact)).otherwise(""), field("version"), F.concat_ws("/", group, artifact))


def from_pyproject(text: Column) -> Column:
    sections = ("project", r"tool\.poetry")
    return F.coalesce(*[stated("pypi", toml(text, s, "name"), toml(text, s, "version")) for s in sections])


def from_metadata(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?s)^(.*?)(\r?\n\r?\n|\z)", 1)
    return stated("pypi", *[F.trim(F.regexp_extract(head, rf"(?m)^{k}:([^\r\n]*)", 1)) for k in ("Name", "Version")])


def from_chart(text: Column) -> Column:
    return stated("helm", *[F.regexp_extract(text, rf"""(?m)^{k}:[ \t]*['"]?([^'"#\s]+)""", 1) for k in ("name", "version")])


def assigned(text: Column, attribute: str) -> Column:
    """The first quoted text on the line that sets an attribute; a call around it doesn't matter."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.split_part(F.trim(F.split_part(x, F.lit("="), F.lit(1))), F.lit("."), F.lit(-1)) == attribute)
    value = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.split_part(F.translate(F.substr(value, F.locate("=", value) + F.lit(1)), "'", '"'), F.lit('"'), F.lit(2))


def from_gemspec(text: Column) -> Column:
    return stated("gem", assigned(text, "name"), assigned(text, "version"))


def from_go_mod(text: Column) -> Column:
    """The path that follows the word `module` at the start of a line."""
    words = F.transform(F.split(text, "\r?\n"), lambda x: F.split(x, r"\s+"))
    stated_ = F.filter(words, lambda w: (w[0] == "module") & (F.size(w) > 1))
    return stated("golang", F.coalesce(F.get(F.get(stated_, F.lit(0)), F.lit(1)), F.lit("")), F.lit(""))


def identity(path: Column, text: Column) -> Column:
    """By the manifest's name; null where it is none, or states no name."""
    base = P.basename(path)
    return (
        F.when(base == "package.json", from_json("npm", text))
        .when(base == "composer.json", from_json("composer", text))
        .when(base == "Cargo.toml", stated("cargo", toml(text, "package", "name"), toml(text, "package", "version")))
        .when(base == "go.mod", from_go_mod(text))
        .when(base == "pom.xml", from_pom(text))
        .when(base == "pyproject.toml", from_pyproject(text))
        .when((base == "METADATA") & P.parent(path).endswith(".dist-info"), from_metadata(text))
        .when(base == "Chart.yaml", from_chart(text))
        .when(base.endswith(".gemspec"), from_gemspec(text))
    )


def roots(files: DataFrame) -> DataFrame:
    """(path, text) -> path, root, kind, name, version, purl of manifests that state a name."""
    root = F.when(P.basename(F.col("path")) == "METADATA", P.parent(P.parent(F.col("path")))).otherwise(P.parent(F.col("path")))
    found = files.select("path", root.alias("root"), F.explode(F.array(identity(F.col("path"), F.col("text")))).alias("i"))
    return found.filter("i is not null").select("path", "root", "i.*")
