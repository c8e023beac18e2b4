"""Which product's lifecycle a component follows, and the values that lifecycle records come in.

Null names, versions and package URLs count as empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The product and the form of its cycles by the start of a package URL.
BY_PURL = {
    "pkg:apk/alpine": ("alpine", "major.minor"), "pkg:deb/debian": ("debian", "major"), "pkg:deb/ubuntu": ("ubuntu", "major.minor"),
    "pkg:rpm/centos": ("centos", "major"), "pkg:rpm/rhel": ("rhel", "major"), "pkg:rpm/rocky": ("rocky-linux", "major"),
    "pkg:rpm/almalinux": ("almalinux", "major"), "pkg:rpm/fedora": ("fedora", "major"), "pkg:rpm/amazonlinux": ("amazon-linux", "major"),
    "pkg:rpm/opensuse": ("opensuse", "major.minor"),
}
# The same by a component's name in lower case.
BY_NAME = {
    "node": ("nodejs", "major"), "nodejs": ("nodejs", "major"), "python": ("python", "major.minor"), "python3": ("python", "major.minor"),
    "go": ("go", "major.minor"), "golang": ("go", "major.minor"), "openjdk": ("openjdk", "major"), "java": ("openjdk", "major"),
    "jdk": ("openjdk", "major"), "jre": ("openjdk", "major"), "ruby": ("ruby", "major.minor"), "php": ("php", "major.minor"),
    "perl": ("perl", "major.minor"), "rust": ("rust", "major.minor"), "dotnet": ("dotnet", "major"),
    "postgres": ("postgresql", "major"), "postgresql": ("postgresql", "major"), "mysql": ("mysql", "major.minor"),
    "mariadb": ("mariadb", "major.minor"), "redis": ("redis", "major"), "mongodb": ("mongodb", "major"), "sqlite": ("sqlite", "major.minor"),
    "cassandra": ("cassandra", "major"), "elasticsearch": ("elasticsearch", "major"),
    "kubernetes": ("kubernetes", "major.minor"), "docker": ("docker-engine", "major"), "containerd": ("containerd", "major.minor"),
    "podman": ("podman", "major"), "nginx": ("nginx", "major.minor"), "apache": ("apache", "major.minor"), "httpd": ("apache", "major.minor"),
    "haproxy": ("haproxy", "major.minor"),
    "alpine": ("alpine", "major.minor"), "debian": ("debian", "major"), "ubuntu": ("ubuntu", "major.minor"), "centos": ("centos", "major"),
    "rhel": ("rhel", "major"),
}


def entry(value: tuple[str, str]) -> Column:
    return F.struct(F.lit(value[0]).alias("product"), F.lit(value[1]).alias("form"))


def product(purl: Column, name: Column) -> Column:
    """struct(product, form), by package URL first, then by name; null where neither tells."""
    by_name = F.create_map(*[c for k, v in BY_NAME.items() for c in (F.lit(k), entry(v))])
    return F.coalesce(*[F.when(purl.startswith(k), entry(v)) for k, v in BY_PURL.items()], F.try_element_at(by_name, F.lower(name)))


def cycle(version: Column, form: Column) -> Column:
    """The version's leading numbers in the product's form; '' without a version."""
    version = F.coalesce(version, F.lit(""))
    return F.when(form == "major", F.substring_index(version, ".", 1)).otherwise(F.substring_index(version, ".", 2))


def products(components: DataFrame) -> DataFrame:
    """(bom_ref, purl, name, version) -> bom_ref, product, cycle, of the components that follow a known lifecycle."""
    # within transform() the inputs are computed once, whatever the number of their uses
    named = F.transform(F.array(F.struct(F.coalesce("purl", F.lit("")).alias("purl"), F.coalesce("name", F.lit("")).alias("name"))), lambda c: product(c["purl"], c["name"]))
    known = F.filter(named, lambda p: p.isNotNull())
    return components.select("bom_ref", "version", F.explode(known).alias("p")).select("bom_ref", "p.product", cycle(F.col("version"), F.col("p.form")).alias("cycle"))


def json_text(raw: Column) -> Column:
    """The text of a JSON string, null for any other JSON value."""
    return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))


def iso_date(text: Column) -> Column:
    """A date written as yyyy-mm-dd, null for anything else."""
    text = F.trim(text)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def date_or_flag(raw: Column) -> Column:
    """struct(date, flag) of a JSON value that is a date or a boolean; flag is 'true', 'false' or ''."""
    raw = F.trim(raw)
    return F.struct(iso_date(json_text(raw)).alias("date"), F.when(raw.isin("true", "false"), raw).otherwise("").alias("flag"))


def long_term(raw: Column) -> Column:
    """Whether a cycle has long-term support: true, or any text, such as the date from which it has."""
    raw = F.trim(raw)
    return F.coalesce((raw == "true") | (json_text(raw) != ""), F.lit(False))
