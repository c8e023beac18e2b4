"""Images: overlay fold, layer attribution, base differences, path rules, clusters, lookups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlake.functions import paths as P


def effective(entries: DataFrame, key: str = "path") -> DataFrame:
    """(layer, seq, path, op) -> live paths with the layer that owns them.

    The last event of a path decides; max_by reduces it before the shuffle, over a total order (a whiteout
    after an add of the same place). An opaque marker hides what earlier layers put below its directory.
    """
    order = F.struct("layer", "seq", "op")
    last = entries.filter("op in ('add', 'wh')").groupBy(key).agg(F.max(order).alias("last")).filter("last.op = 'add'").select(key, F.col("last.layer").alias("layer"), F.col("last.seq").alias("seq"))
    opaque = entries.filter("op = 'opq'").groupBy(F.col(key).alias("dir")).agg(F.max("layer").alias("hides"))
    above = last.withColumn("dir", F.explode(P.ancestors(F.col(key)))).join(opaque, "dir").filter("hides > layer").select(key).distinct()
    return last.join(above, key, "left_anti")


def attributed(components: DataFrame, live: DataFrame) -> DataFrame:
    """(bom_ref, locations) -> layer of the first location that is live; none where no location is."""
    places = components.select("bom_ref", F.posexplode("locations").alias("pos", "path"))
    hit = places.join(live.select("path", "layer"), "path").groupBy("bom_ref").agg(F.min(F.struct("pos", "layer", "path")).alias("m"))
    return components.select("bom_ref").join(hit, "bom_ref", "left").select("bom_ref", "m.layer", "m.path", F.when(F.col("m").isNull(), "none").otherwise("medium").alias("confidence"))


def content_diff(target: DataFrame, base: DataFrame) -> DataFrame:
    """(path, h, ord) twice -> target paths as base (same content), base modified (same path only) or app."""
    final = target.groupBy("path").agg(F.max_by("h", "ord").alias("h"))
    by_hash = base.groupBy("h").agg(F.min_by("path", "ord").alias("base_path"))
    by_path = base.select("path").distinct().withColumn("known", F.lit(True))
    found = final.join(by_hash, "h", "left").join(by_path, "path", "left")
    origin = F.when(F.col("base_path").isNotNull() | F.col("known"), "base").otherwise("app")
    state = F.when(F.col("base_path").isNotNull(), "same").when(F.col("known"), "modified").otherwise("")
    return found.select("path", origin.alias("origin"), state.alias("state"), F.coalesce("base_path", F.lit("")).alias("base_path"))


def layer_prefix(target: DataFrame, base: DataFrame) -> DataFrame:
    """(idx, digest) twice -> whether all base layers start the target, and how many do."""
    joined = base.join(target.withColumnRenamed("digest", "own"), "idx", "left")
    return joined.agg(F.coalesce(F.bool_and(F.col("digest").eqNullSafe(F.col("own"))), F.lit(False)).alias("is_prefix"), F.count("*").alias("base_layers"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression of the whole path: `*` and `?` stop at a slash, `[a-c]` and `[^a-c]` take one character, a backslash escapes.

    A broken one raises ValueError.
    """
    out, i = "", 0

    def one() -> str:
        nonlocal i
        if i < len(glob) and glob[i] == "\\":
            i += 1
        if i >= len(glob):
            raise ValueError(f"broken glob: {glob!r}")
        i += 1
        return re.escape(glob[i - 1])

    while i < len(glob):
        c = glob[i]
        if c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[":
            i += 1
            negated = glob[i : i + 1] == "^"
            i += negated
            ranges = []
            while not (ranges and glob[i : i + 1] == "]"):
                if glob[i : i + 1] in ("]", "-", ""):
                    raise ValueError(f"broken glob: {glob!r}")
                low = high = one()
                if glob[i : i + 1] == "-":
                    i += 1
                    if glob[i : i + 1] in ("]", "-", ""):
                        raise ValueError(f"broken glob: {glob!r}")
                    high = one()
                if low[-1] <= high[-1]:  # a range that ends before it begins holds nothing
                    ranges.append(f"{low}-{high}")
                else:
                    ranges.append("")
            i += 1
            body = "".join(ranges)
            out += f"[{'^' * negated}{body}]" if body else ("(?s:.)" if negated else r"[^\s\S]")
        else:
            out += one()
    return rf"\A{out}\z"


#: Rules: name, action, kind, value. Exact names come first, then the longest prefix, the longest suffix, globs in order, then patterns in order.
RULES = [
    ("man-pages", "skip", "prefix", "/usr/share/man/"), ("doc-dirs", "skip", "prefix", "/usr/share/doc/"), ("zoneinfo", "skip", "prefix", "/usr/share/zoneinfo/"), ("locale-data", "skip", "prefix", "/usr/share/locale/"), ("pam-config", "skip", "prefix", "/etc/pam.d/"),
    ("readme", "skip", "exact", "README"), ("licence", "skip", "exact", "LICENSE"),
    ("english", "mark_noise", "prefix", "/en/"), ("english-ones", "skip", "prefix", "/en/1"), ("french", "mark_metadata", "prefix", "/fr/"), ("html", "redundant_under_archive", "suffix", ".html"), ("seven", "skip", "suffix", "7.html"), ("german-ones", "mark_noise", "glob", "/?e/[1-3]*"), ("numbers", "mark_number", "regex", "^/[a-z]+/[0-9]{1,2}$"), ("spanish", "mark_noise", "regex", "^/es/"),
]


def classified(paths: DataFrame, rules: list[tuple] = RULES, path: str = "path") -> DataFrame:
    """Adds rule and action. Prefixes and suffixes are equi-joins on the affixes of a path up to the longest
    rule, in place: a map from values to rules is looked up, so nothing is shuffled and no rule is scanned."""

    def lookup(kind: str, keys: Column) -> Column:
        own = {}
        for n, a, k, v in rules:
            if k == kind:
                own.setdefault(v, (n, a))  # the first of equal values wins
        if not own:
            return F.lit(None).cast("struct<n:string,a:string>")
        table = F.create_map(*[x for v, (n, a) in own.items() for x in (F.lit(v), F.struct(F.lit(n).alias("n"), F.lit(a).alias("a")))])
        return F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(table, k)), lambda r: r.isNotNull()), F.lit(0))

    p = F.col(path)
    longest = lambda kind: max((len(v) for _, _, k, v in rules if k == kind), default=0)
    lengths = lambda kind: F.sequence(F.least(F.length(p), F.lit(longest(kind))), F.lit(0), F.lit(-1))
    found = [lookup("exact", F.array(P.basename(p))), lookup("prefix", F.transform(lengths("prefix"), lambda n: F.left(p, n))), lookup("suffix", F.transform(lengths("suffix"), lambda n: F.right(p, n)))]
    patterns = [(n, a, glob_pattern(v)) for n, a, k, v in rules if k == "glob"] + [(n, a, v) for n, a, k, v in rules if k == "regex"]
    found += [F.when(p.rlike(v), F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"))) for n, a, v in patterns]
    return paths.withColumn("hit", F.coalesce(*found)).withColumns({"rule": F.coalesce("hit.n", F.lit("")), "action": F.coalesce("hit.a", F.lit("keep"))}).drop("hit")


#: Names and suffixes of documents, sources and metadata (fixed values).
DOC_NAMES = (
    "AUTHORS", "CHANGELOG", "CHANGELOG.md", "CHANGES", "CHANGES.md", "CHANGES.txt", "CODEOWNERS", "CONTRIBUTING", "CONTRIBUTORS", "COPYING", "COPYING.LIB", "COPYRIGHT", "INSTALL", "INSTALL.md",
    "LICENCE", "LICENCE.md", "LICENCE.txt", "LICENSE", "LICENSE.md", "LICENSE.txt", "MAINTAINERS", "NEWS", "NEWS.md", "NOTICE", "NOTICE.md", "NOTICE.txt", "PATENTS", "README", "README.md", "README.rst", "README.txt", "SECURITY", "SECURITY.md", "THANKS", "TODO", "TODO.md", "VERSION",
)
DOC_SUFFIXES = (".asc", ".c", ".cc", ".cpp", ".cxx", ".dwo", ".dwp", ".gpg", ".h", ".hpp", ".hxx", ".map", ".o", ".obj", ".pyi", ".sig", ".sym", ".symtab", ".ts", ".tsx")


def documentation(path: Column) -> Column:
    """By the whole name, as it is written, or by what follows the last dot."""
    return P.basename(path).isin(*DOC_NAMES) | P.extension(path).isin(*DOC_SUFFIXES)


#: What a directory's direct children tell of a source tree (fixed values): names in lower case but for build files.
CHILDREN = {
    "makefile": r"^(Makefile|makefile|GNUmakefile)$", "configure": r"^configure(\.ac|\.in)?$", "cmake": r"^CMakeLists\.txt$",
    "readme": r"(?i)^readme", "license": r"(?i)^(licen[sc]e|copying$|copying\.lib$)", "src": r"(?i)^src$", "include": r"(?i)^include$", "tests": r"(?i)^(tests?|spec)$",
}
#: Scores (fixed values): signals that must all be there, and points.
DENSITY = [(("makefile", "configure"), 5), (("cmake",), 4), (("versioned",), 5), (("src", "include"), 3), (("tests",), 2), (("license", "readme"), 2), (("over_100",), 1), (("over_1000",), 2)]
#: Forms of a directory's own name that state a version, in the order in which they are tried (fixed values).
NAME_FORMS = (
    r"^([A-Za-z][A-Za-z0-9_+.-]*?)-version-(\d[A-Za-z0-9._+-]*)$",
    r"^([A-Za-z][A-Za-z0-9_+.-]*?)-v(\d[A-Za-z0-9._+-]*)$",
    r"^([A-Za-z][A-Za-z0-9+.-]*?)_(\d[A-Za-z0-9._+-]*)$",
    r"^([A-Za-z][A-Za-z0-9_+.-]*?)-(\d[A-Za-z0-9._+-]*)$",
)
#: Direct children and points from which a directory is a source tree.
LEAST_CHILDREN, LEAST_SCORE = 3, 7


def named_version(own: Column) -> tuple[Column, Column]:
    """Name and version that a directory's name states by the first form that fits, '' without."""
    part = lambda group: F.coalesce(*[F.when(own.rlike(f), F.regexp_extract(own, f, group)) for f in NAME_FORMS], F.lit(""))
    return part(1), part(2)


def directories(files: DataFrame) -> DataFrame:
    """(path, size) -> for every directory: files and bytes below it, distinct direct children, and what these tell.

    With a column `claimed`, `any_claimed` tells whether a file below is. Null paths and files at the root have no
    directory; an empty table gives no rows.
    """
    more = ["claimed"] if "claimed" in files.columns else []
    parts = F.split("path", "/")
    below = files.select("path", "size", *more, F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"), parts.alias("parts")).filter("n > 0").select("path", "size", *more, F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("dir"), F.get("parts", F.col("n")).alias("child"))
    told = [F.bool_or(F.col("child").rlike(pattern)).alias(name) for name, pattern in CHILDREN.items()]
    return below.groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.count_distinct("child").alias("children"), *told, *[F.bool_or(c).alias("any_claimed") for c in more])


def density(dirs: DataFrame) -> DataFrame:
    """Adds the score of each directory, and name and version that its own name states ('' without)."""
    own = P.basename(F.col("dir"))
    name, version = named_version(own)
    scored = dirs.withColumns({"name": name, "version": version})
    signs = {"versioned": F.col("version") != "", "over_100": F.col("n_files") > 100, "over_1000": F.col("n_files") > 1000, **{c: F.col(c) for c in CHILDREN}}
    return scored.withColumn("score", reduce(lambda a, b: a + b, [F.when(reduce(lambda x, y: x & y, [signs[n] for n in names]), points).otherwise(0) for names, points in DENSITY]))


def dense(dirs: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """Scores directories and picks the first, in order of names, that qualifies under each top directory.

    Taking a directory blocks the rest of its top directory, so one minimum a top directory is the whole rule.
    """
    scored = density(dirs).filter((F.col("children") >= LEAST_CHILDREN) & (F.col("score") >= least))
    return scored.groupBy(F.split_part(F.col("dir"), F.lit("/"), F.lit(1)).alias("top")).agg(F.min(F.struct("dir", "score", "n_files")).alias("m")).select("top", "m.dir", "m.score", "m.n_files")


def contained(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path), (root) -> the deepest root that a path lies under."""
    up = files.select("path", F.explode(P.ancestors(F.col("path"))).alias("root"))
    return up.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def lookup(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(path, h), (h, name, ord) -> the first catalogue entry of the same content."""
    first = catalogue.groupBy("h").agg(F.min_by("name", "ord").alias("match"))
    return files.join(first, "h")


def buckets(metrics: DataFrame, bounds: list[float]) -> DataFrame:
    """Cumulative histogram, counter without negatives, last gauge, by label: one pass."""
    value = F.col("value")
    return metrics.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.when(value > 0, value).otherwise(0.0)).alias("counter"), F.max_by("value", F.struct("ts", "ord")).alias("gauge"), *[F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    )


#: Bytes from which contents aren't hashed but refused.
MOST_HASHED = 1 << 30


def hashed(contents: DataFrame, *more: str) -> DataFrame:
    """(path, content) -> path, hashes: SHA-256 first, then of `more` sha1 and sha512; too large a content raises an error."""
    body = F.when(F.octet_length("content") <= MOST_HASHED, F.col("content")).when(F.col("content").isNotNull(), F.raise_error(F.concat(F.lit("too large to hash: "), "path")))
    known = {"sha256": F.sha2(body, 256), "sha1": F.sha1(body), "sha512": F.sha2(body, 512)}
    return contents.select("path", F.array(*[F.struct(F.lit(a).alias("alg"), known[a].alias("value")) for a in dict.fromkeys(("sha256", *more))]).alias("hashes"))


def fingerprinted(files: DataFrame, *catalogues: DataFrame) -> DataFrame:
    """Files (path, alg, digest) with `name` and `catalogue` (its number) of the first catalogue (alg, digest, ord, name) that has the digest of the algorithm, null without.

    Algorithms and digests are compared without case and outer white space; of equal entries of a catalogue the last counts.
    """
    keyed = lambda df: df.withColumn("own", F.concat_ws(":", F.lower(F.trim("alg")), F.lower(F.trim("digest"))))
    hits = None
    for n, c in enumerate(catalogues):
        own = keyed(c).groupBy("own").agg(F.max_by("name", "ord").alias("name")).withColumn("catalogue", F.lit(n))
        hits = own if hits is None else hits.unionByName(own)
    first = hits.groupBy("own").agg(F.min(F.struct("catalogue", "name")).alias("m")).select("own", "m.name", "m.catalogue")
    return keyed(files).join(first, "own", "left").drop("own")


def live_files(entries: DataFrame, key: str = "path") -> DataFrame:
    """Entries (layer, seq, path, op) of regular files whose layer owns the path in the end; of one path a layer may have several, and all are given."""
    owner = effective(entries, key).select(key, "layer")
    return entries.filter("op = 'add'").join(owner, [key, "layer"], "left_semi")


def coverage(components: DataFrame, *keys: str) -> DataFrame:
    """keys, components, and the shares of them that have a CPE name, a package URL and an origin; 0 without components."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "") / F.greatest(F.count("*"), F.lit(1))
    return components.groupBy(*keys).agg(F.count("*").alias("components"), has("cpe").alias("with_cpe"), has("purl").alias("with_purl"), has("origin").alias("with_origin"))
