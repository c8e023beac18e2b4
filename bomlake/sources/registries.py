"""Payloads of package registries, fetched beforehand: (purl_key, text) -> metadata rows.

purl_key, description, author, supplier, homepage, repository, bugs, docs, licences, hashes; '' stands for
absent. Texts that are no JSON object give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classifiers that name one licence (fixed values).
CLASSIFIERS = {
    "MIT License": "MIT", "Apache Software License": "Apache-2.0", "BSD License": "BSD-3-Clause", "GNU General Public License v2 (GPLv2)": "GPL-2.0-only", "GNU General Public License v3 (GPLv3)": "GPL-3.0-only",
    "GNU Lesser General Public License v3 (LGPLv3)": "LGPL-3.0-only", "ISC License (ISCL)": "ISC", "Mozilla Public License 2.0 (MPL 2.0)": "MPL-2.0",
}
CLASSIFIED = "License :: OSI Approved :: "
#: Algorithms of integrity texts and their digests' bytes (fixed values).
INTEGRITY = ("sha256", "sha384", "sha512")


def field(text: Column, *paths: str) -> Column:
    """The first of several fields that isn't empty, '' without one."""
    return F.coalesce(*[F.when(v != "", v) for v in (F.get_json_object(text, f"$.{p}") for p in paths)], F.lit(""))


def either(text: Column, path: str, inner: str) -> Column:
    """A field that is a text, or an object with a text."""
    whole = F.coalesce(F.get_json_object(text, f"$.{path}"), F.lit(""))
    return F.when(whole.startswith("{"), field(text, f"{path}.{inner}")).when(whole.startswith("["), "").otherwise(whole)


def licence(text: Column) -> Column:
    """struct(id, name), null for no licence; an id only where the text is one word and no expression."""
    t = F.trim(text)
    wrapped = t.rlike(r"(?s)^\(.*\)$")
    name = F.when(wrapped, F.trim(F.regexp_replace(t, r"(?s)^\((.*)\)$", "$1"))).otherwise(t)
    return F.when((t != "") & (F.lower(t) != "unlicensed"), F.struct(F.when(wrapped | t.contains(" "), "").otherwise(t).alias("id"), name.alias("name")))


def person(text: Column) -> Column:
    """struct(name, email, url) of 'Name <email> (url)'."""
    url, mail = r"\(([^)]*)\)", "<([^>]*)>"
    name = F.trim(F.regexp_replace(F.regexp_replace(text, rf"^([^(]*){url}", "$1"), f"^([^<]*){mail}", "$1"))
    return F.struct(name.alias("name"), F.trim(F.regexp_extract(text, mail, 1)).alias("email"), F.trim(F.regexp_extract(text, url, 1)).alias("url"))


def repository_url(url: Column) -> Column:
    clean = F.regexp_replace(F.trim(url), r"^git\+", "")
    return F.when(clean.rlike("[?#]"), clean).otherwise(F.regexp_replace(clean, r"\.git$", ""))


def integrity(text: Column) -> Column:
    """struct(alg, value) of 'alg-base64', null where it is neither."""
    alg, body = F.lower(F.trim(F.regexp_extract(text, "^([^-]*)-", 1))), F.regexp_extract(text, "^[^-]*-(.*)$", 1)
    value = F.lower(F.hex(F.try_to_binary(body, F.lit("base64"))))
    return F.when(alg.isin(*INTEGRITY) & (value != ""), F.struct(alg.alias("alg"), value.alias("value")))


def some(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def npm(payloads: DataFrame) -> DataFrame:
    t = F.col("text")
    listed = F.filter(F.transform(F.from_json(F.get_json_object(t, "$.licenses"), "array<struct<type:string>>"), lambda x: licence(F.coalesce(x["type"], F.lit("")))), lambda v: v.isNotNull())
    single = some(licence(either(t, "license", "type")))
    author = person(either(t, "author", "name"))["name"]
    sha1 = F.when(field(t, "dist.shasum") != "", F.struct(F.lit("sha1").alias("alg"), field(t, "dist.shasum").alias("value")))
    return payloads.filter(t.rlike(r"^\s*\{")).select(
        "purl_key", field(t, "description").alias("description"), author.alias("author"), F.coalesce(F.when(author != "", author), field(t, "maintainers[0].name")).alias("supplier"), field(t, "homepage").alias("homepage"),
        repository_url(either(t, "repository", "url")).alias("repository"), either(t, "bugs", "url").alias("bugs"), F.lit("").alias("docs"), F.when(F.size(single) > 0, single).otherwise(F.coalesce(listed, single)).alias("licences"), some(sha1, integrity(field(t, "dist.integrity"))).alias("hashes"),
    )


#: Labels of a source repository, in order (fixed values).
SOURCES = ("Source", "Source Code", "Repository", "GitHub", "Code")


def labelled(urls: Column, *words: str) -> Column:
    """The URL of the first label, in order of names, that holds one of the words."""
    holds = lambda e: F.lower(e["key"]).rlike("|".join(words)) & (e["value"] != "")
    return F.coalesce(F.get(F.filter(F.array_sort(F.map_entries(urls)), holds), F.lit(0))["value"], F.lit(""))


def digests(text: Column) -> Column:
    """Digests of a release's files, the first of each algorithm."""
    files = F.from_json(F.get_json_object(text, "$.urls"), "array<struct<digests:map<string,string>>>")
    pairs = F.filter(F.flatten(F.transform(files, lambda f: F.map_entries(F.coalesce(f["digests"], F.create_map().cast("map<string,string>"))))), lambda e: e["value"] != "")
    names = F.transform(pairs, lambda e: F.lower(e["key"]))
    first = F.filter(pairs, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.coalesce(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("alg"), e["value"].alias("value"))), F.array().cast("array<struct<alg:string,value:string>>"))


def pypi(payloads: DataFrame) -> DataFrame:
    t = F.col("text")
    info = lambda *names: field(t, *[f"info.{n}" for n in names])
    urls = F.from_json(F.get_json_object(t, "$.info.project_urls"), "map<string,string>")
    known = F.create_map(*[F.lit(x) for c, name in CLASSIFIERS.items() for x in (CLASSIFIED + c, name)])
    classified = F.get(F.filter(F.transform(F.from_json(F.get_json_object(t, "$.info.classifiers"), "array<string>"), lambda c: F.try_element_at(known, c)), lambda v: v.isNotNull()), F.lit(0))
    stated = info("license_expression", "license")
    author = info("author", "maintainer")
    filled = lambda value, other: F.when(value != "", value).otherwise(other)
    return payloads.filter(t.rlike(r"^\s*\{")).select(
        "purl_key", info("summary", "description").alias("description"), author.alias("author"), author.alias("supplier"), info("home_page", "project_url").alias("homepage"),
        repository_url(F.coalesce(*[F.when(v != "", v) for v in (F.try_element_at(urls, F.lit(x)) for x in SOURCES)], F.lit(""))).alias("repository"), filled(info("bugtrack_url"), labelled(urls, "issues", "bug", "tracker")).alias("bugs"), filled(info("docs_url"), labelled(urls, "docs", "documentation")).alias("docs"),
        F.when(stated != "", some(licence(stated))).otherwise(some(licence(F.coalesce(classified, F.lit(""))))).alias("licences"), digests(t).alias("hashes"),
    )


#: Licences of POMs by what their names hold, in order (fixed values); MIT also stands alone.
POM_LICENCES = (
    ("apache license, version 2.0", "Apache-2.0"), ("apache 2", "Apache-2.0"), ("apache-2.0", "Apache-2.0"), ("mit license", "MIT"),
    ("bsd 3-clause", "BSD-3-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("bsd 2-clause", "BSD-2-Clause"), ("bsd-2-clause", "BSD-2-Clause"),
    ("eclipse public license 2", "EPL-2.0"), ("eclipse public license 1", "EPL-1.0"), ("gnu lesser general public license, version 2.1", "LGPL-2.1-only"), ("gnu lesser general public license, version 3", "LGPL-3.0-only"), ("isc", "ISC"),
)
POM = "artifactId string, version string, description string, url string, licenses struct<license:array<struct<name:string,url:string>>>, organization struct<name:string>, developers struct<developer:array<struct<name:string>>>, scm struct<url:string,connection:string>, issueManagement struct<url:string>"


def pom_licence(name: Column) -> Column:
    lower = F.lower(F.trim(name))
    out = F.lit("")
    for held, id_ in reversed(POM_LICENCES):
        fits = lower.contains(held)
        out = F.when(fits | (lower == "mit") if held == "mit license" else fits, id_).otherwise(out)
    return out


def maven(payloads: DataFrame) -> DataFrame:
    """(purl_key, namespace, text) of POMs: the same columns as npm(). The organisation, else the first developer, else the group supplies."""
    d = payloads.select("purl_key", "namespace", F.from_xml(F.col("text"), POM, {"ignoreNamespace": "true"}).alias("p")).filter("p IS NOT NULL")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    organisation = text("p.organization.name")
    developer = F.coalesce(F.get("p.developers.developer.name", F.lit(0)), F.lit(""))
    supplier = F.coalesce(*[F.when(x != "", x) for x in (organisation, developer, text("namespace"))], F.lit(""))
    listed = F.filter(F.coalesce("p.licenses.license", F.array().cast("array<struct<name:string,url:string>>")), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    repository = repository_url(text("p.scm.url"))
    return d.select(
        "purl_key", F.trim(text("p.description")).alias("description"), F.when(organisation == "", developer).otherwise("").alias("author"), supplier.alias("supplier"), text("p.url").alias("homepage"),
        F.when(repository != "", repository).otherwise(repository_url(text("p.scm.connection"))).alias("repository"), text("p.issueManagement.url").alias("bugs"), F.lit("").alias("docs"),
        F.transform(listed, lambda x: F.struct(pom_licence(x["name"]).alias("id"), x["name"].alias("name"))).alias("licences"), F.array().cast("array<struct<alg:string,value:string>>").alias("hashes"),
    )
