"""Files that no package accounts for: what kind they are, which are kept, which are worth a lookup.

Null paths count as empty, null heads as no bytes; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a path noise.
NOISE_PREFIXES = [
    "usr/share/man/", "usr/share/doc/", "usr/share/info/", "usr/share/locale/", "usr/share/i18n/", "usr/share/zoneinfo/", "usr/share/help/",
    "usr/lib/locale/", "var/cache/", "var/log/", "var/lib/dpkg/info/", "var/lib/apt/", "tmp/", "run/", "dev/", "proc/", "sys/",
    "etc/ssl/certs/", "etc/ca-certificates/",
]
NOISE_FOLDERS = ["/__pycache__/", "/.cache/", "/.npm/", "/.yarn/"]
NOISE_NAMES = ["__pycache__", ".DS_Store", "Thumbs.db", ".gitkeep", ".gitignore", "__init__.pyc"]
NOISE_SUFFIXES = [".pyc", ".pyo", ".pyd", ".dwarf", ".debug", ".la", ".gmo", ".mo", ".cache"]
# Extensions and first bytes (hexadecimal) of the categories.
LIBRARIES, JAVA, CONFIG = [".so", ".dylib", ".dll"], [".jar", ".war", ".ear"], [".yaml", ".yml", ".json", ".toml", ".ini", ".conf", ".cfg", ".pem", ".crt", ".cer", ".key", ".md", ".txt", ".rst", ".html", ".htm"]
ELF, PE, MACH, ZIP, SCRIPT = "7F454C46", "4D5A", ["FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"], "504B0304", "2321"
# Categories that give no component, and the limits of lookups and components.
DROPPED = ["noise", "static-archive", "config", "redundant"]
LEAST_BYTES, MOST_COMPONENTS = 4096, 10_000


def either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def noise(path: Column) -> Column:
    """By folder, name or suffix."""
    inner = F.regexp_replace(path, "^/", "")
    rooted = F.concat(F.lit("/"), inner)
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return either([inner.startswith(p) for p in NOISE_PREFIXES] + [rooted.contains(f) for f in NOISE_FOLDERS] + [path.endswith(s) for s in NOISE_SUFFIXES]) | name.isin(NOISE_NAMES)


def category(path: Column, head: Column) -> Column:
    """noise, then what the extension tells, then what the first bytes tell, else unknown."""
    given = F.struct(F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.hex(F.substring(head, 1, 4)), F.lit("")).alias("first"))
    return F.transform(F.array(given), lambda c: category_of(c["path"], c["first"]))[0]  # computed once, used often


def category_of(path: Column, first: Column) -> Column:
    """category() of a path and the hexadecimal first four bytes, neither null."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    archive = first == ZIP
    return (
        F.when(noise(path), "noise")
        .when(path.endswith(".a"), "static-archive")
        .when(extension.isin(LIBRARIES), "library")
        .when(extension.isin(JAVA), "archive")
        .when(extension.isin(CONFIG), "config")
        .when((first == ELF) | first.startswith(PE) | first.isin(MACH), "executable")
        .when(archive, "archive")
        .when(first.startswith(SCRIPT), "script")
        .otherwise("unknown")
    )


def looked_up(kind: Column, size: Column, also: tuple[str, ...] = ()) -> Column:
    """Whether contents are worth a lookup: executables, libraries and the categories of `also`, unless small."""
    return (size >= LEAST_BYTES) & kind.isin("executable", "library", *also)


def scanned(files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(ord, path, head, size) -> ord, path, size, category, lookup, of the files that become components."""
    kept = files.withColumns({"category": category(F.col("path"), F.col("head"))}).filter(~F.col("category").isin(DROPPED))
    return kept.select("ord", "path", "size", "category", looked_up(F.col("category"), F.col("size"), also).alias("lookup"))


def capped(components: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """The first components by `ord`: the scan stops there, as a safeguard that callers set."""
    return components.orderBy("ord").limit(most)
