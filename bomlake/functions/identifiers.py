"""Package URLs, CPE names, versions, hashes and licences as Column expressions. '' stands for absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def decoded(value: Column) -> Column:
    """Percent-decoding; a plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def parse_purl(purl: Column) -> Column:
    """struct(type, namespace, name, version, qualifiers, subpath); null where it is no package URL.

    The last '#' starts the subpath, the last '?' before it the qualifiers, the first '@' the version.
    """
    body = F.regexp_replace(purl, r"^pkg:/*", "")
    main = F.regexp_replace(F.regexp_replace(body, "#[^#]*$", ""), r"\?[^?]*$", "")
    path = F.regexp_replace(F.split_part(main, F.lit("@"), F.lit(1)), "/+$", "")
    whole = F.struct(
        F.lower(F.split_part(path, F.lit("/"), F.lit(1))).alias("type"),
        decoded(F.regexp_extract(path, "^[^/]+/(.+)/[^/]*$", 1)).alias("namespace"),
        decoded(F.regexp_extract(path, "/([^/]+)$", 1)).alias("name"),
        decoded(F.regexp_extract(main, "^[^@]*@(.*)$", 1)).alias("version"),
        F.regexp_extract(F.regexp_replace(body, "#[^#]*$", ""), r"\?([^?]*)$", 1).alias("qualifiers"),
        F.regexp_extract(body, "#([^#]*)$", 1).alias("subpath"),
    )
    return F.when(purl.startswith("pkg:") & path.rlike("^[^/]+/.*[^/]$"), whole)


def format_purl(kind: Column, namespace: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.when(namespace != "", F.concat(namespace, F.lit("/"))).otherwise(""), name, F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))


def ecosystem(purl: Column) -> Column:
    return F.lower(F.regexp_extract(purl, r"^pkg:([^/@?#]*)", 1))


def purl_key(purl: Column) -> Column:
    """Without qualifiers and what follows them, in lower case; a subpath without qualifiers stays."""
    return F.lower(F.when(F.instr(purl, "?") > 1, F.substring_index(purl, "?", 1)).otherwise(purl))


def purl_coordinates(purl: Column) -> Column:
    """Without version, too."""
    return F.split_part(F.lower(F.regexp_replace(purl, r"[?#].*$", "")), F.lit("@"), F.lit(1))


def guess_cpe(p: Column) -> Column:
    """struct(vendor, product) that a parsed package URL suggests."""
    vendor = (
        F.when(p["type"] == "pypi", F.concat(p["name"], F.lit("_project")))
        .when((p["type"] == "maven") & (p["namespace"] != ""), F.element_at(F.split(p["namespace"], r"\."), -1))
        .when((p["type"] == "golang") & (p["namespace"] != ""), F.element_at(F.split(p["namespace"], "/"), -1))
        .otherwise(p["name"])
    )
    return F.struct(F.lower(vendor).alias("vendor"), F.lower(p["name"]).alias("product"))


def build_cpe(part: Column, vendor: Column, product: Column, version: Column) -> Column:
    star = lambda c: F.when(c == "", "*").otherwise(c)
    return F.concat_ws(":", F.lit("cpe:2.3"), part, star(F.lower(vendor)), star(F.lower(product)), star(version), *[F.lit("*")] * 7)


def cpe_valid(cpe: Column) -> Column:
    return cpe.rlike(r"^cpe:2\.3:[aho*](:[^:]*){10}$")


def hash_algorithm(name: Column) -> Column:
    """One name for each algorithm: lower case, dashes dropped but where the name has two numbers."""
    plain = F.translate(F.lower(F.trim(name)), "_", "-")
    return F.when(plain.rlike("^(sha3|blake2b)-?[0-9]+$"), F.regexp_replace(plain, "^(sha3|blake2b)-?", "$1-")).otherwise(F.replace(plain, F.lit("-"), F.lit("")))


def lifecycle_status(eol: Column, eol_bool: Column, support: Column, support_bool: Column, release: Column, now: Column) -> Column:
    """The first that holds: end of life, maintenance, active, unknown."""
    return F.when((eol <= now) | (eol_bool == "true"), "eol").when((support <= now) | (support_bool == "false"), "maintenance").when(release.isNotNull(), "active").otherwise("unknown")


def days_until(date: Column, now: Column) -> Column:
    """Whole days, truncated toward zero."""
    return F.timestamp_diff("DAY", now.cast("timestamp"), date.cast("timestamp"))


#: Severities and their order (fixed values).
SEVERITIES = {"ignored": -1, "info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_name(rank: Column) -> Column:
    out = F.lit("unknown")
    for name, r in SEVERITIES.items():
        out = F.when(rank == r, name).otherwise(out)
    return out


def licence_name(text: Column) -> Column:
    """An SPDX identifier for common spellings, else the text."""
    t = F.lower(text)
    cases = [("mit", "MIT"), ("apache.*2", "Apache-2.0"), ("lgpl.*3|lesser general public.*3", "LGPL-3.0"), ("agpl|affero", "AGPL-3.0"), ("gpl.*3|general public.*3", "GPL-3.0"), ("gpl.*2|general public.*2", "GPL-2.0"), ("bsd.*3|3-clause", "BSD-3-Clause"), ("bsd.*2|2-clause", "BSD-2-Clause"), ("mozilla.*2|mpl", "MPL-2.0")]
    out = text
    for pattern, name in reversed(cases):
        out = F.when(t.rlike(rf"\b({pattern})"), name).otherwise(out)
    return out
