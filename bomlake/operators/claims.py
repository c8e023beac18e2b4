"""What claims a file of an image: clusters (manifests, then dense directories), packages that are known, rules; and the scan's decision on each.

Paths have no leading slash. Null paths have no row; an empty table gives none. Where clusters overlap, a file is that of the deepest
root, of equal roots of the first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bomlake.functions import paths as P
from bomlake.operators import images, untracked

#: Files that mark the directory they are in as one package's own (fixed values); so does the suffix .gemspec.
MANIFESTS = ("package.json", "package-lock.json", "setup.py", "PKG-INFO", "METADATA", "RECORD", "Cargo.toml", "go.mod", "composer.json", "Gemfile", "Gemfile.lock", ".gemspec", "pom.xml", "build.gradle", "DESCRIPTION", "control", "PKGBUILD")
#: Cluster kinds that are applications; others are libraries (fixed values).
APPLICATIONS = ("helm",)
#: Actions of path rules by what they do (fixed values).
DROPS, NOISE, REDUNDANT = ("skip", "redundant_under_archive"), "mark_as_noise", "mark_as_redundant"


def normal(path: Column) -> Column:
    """Without a leading './', then without a leading '/': the weaker form that the scan compares."""
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "^/", "")


def enclosing(path: Column) -> Column:
    """A path and all directories above it."""
    return F.array_append(P.ancestors(path), path)


def held_by(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the deepest of the roots that each file lies under or is; files of none have no row. A root '' holds nothing."""
    up = files.select("path", F.explode(enclosing(F.col("path"))).alias("root"))
    return up.join(roots.filter("root <> ''").select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def sized(files: DataFrame, held: DataFrame) -> DataFrame:
    """root, n_files, bytes."""
    return files.join(held, "path").groupBy("root").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def clusters(files: DataFrame, anchors: DataFrame, density: bool = True) -> DataFrame:
    """Files (path, size) and anchors (ord, path, root, kind, name, version, purl, confidence, method) -> clusters in the order in which they count.

    Anchors come by depth, the deepest first, then by `ord`; dense directories, one a top directory and none with a file of an anchor
    below, by name. Returns place, root, kind, name, version, purl, confidence, method, anchor, n_files, bytes.
    """
    held = held_by(files, anchors)
    first = F.row_number().over(Window.partitionBy("root").orderBy("ord", "path")) == 1  # a few anchors share a root
    deep = F.when(F.col("root") == "", 0).otherwise(P.depth(F.col("root")))
    own = anchors.withColumn("first", first).join(sized(files, held), "root", "left")
    mine = lambda c: F.when(F.col("first"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    told = own.select(
        F.struct(F.lit(0).alias("stage"), (-deep).alias("depth"), F.col("ord").cast("long").alias("ord"), F.lit("").alias("dir")).alias("place"),
        "root", "kind", "name", "version", "purl", F.col("confidence").cast("double").alias("confidence"), "method", F.col("path").alias("anchor"), mine(F.col("n_files")).alias("n_files"), mine(F.col("bytes")).alias("bytes"),
    )
    if not density:
        return told
    marked = files.join(held.select("path", F.lit(True).alias("claimed")), "path", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    scored = images.density(images.directories(marked)).filter((F.col("children") >= images.LEAST_CHILDREN) & (F.col("score") >= images.LEAST_SCORE) & ~F.col("any_claimed"))
    # taking a directory blocks what is left of its top directory, and names are taken in order
    dense = scored.groupBy(F.split_part(F.col("dir"), F.lit("/"), F.lit(1)).alias("top")).agg(F.min(F.struct("dir", "name", "version", "score", "n_files", "bytes")).alias("d")).select("d.*")
    name = F.when(F.col("name") != "", F.col("name")).otherwise(P.basename(F.col("dir")))
    purl = F.concat(F.lit("pkg:generic/"), name, F.when(F.col("version") != "", F.concat(F.lit("@"), "version")).otherwise(""), F.lit("?root=/"), F.col("dir"))
    found = dense.select(
        F.struct(F.lit(1).alias("stage"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"), F.col("dir").alias("dir")).alias("place"),
        F.col("dir").alias("root"), F.lit("generic").alias("kind"), name.alias("name"), "version", purl.alias("purl"), F.least(F.lit(1.0), F.col("score") / 10.0).alias("confidence"), F.concat(F.lit("density:score="), "score").alias("method"), F.lit("").alias("anchor"), F.col("n_files").cast("long").alias("n_files"), F.col("bytes").cast("long").alias("bytes"),
    )
    return told.unionByName(found)


def bare(purl: Column) -> Column:
    return F.substring_index(purl, "?", 1)


def coordinates(purl: Column) -> Column:
    """Kind, namespace and name, null without: the version and what follows it left out."""
    body = F.substring_index(bare(F.substring(purl, 5, 1 << 30)), "@", 1)
    return F.when(purl.startswith("pkg:") & (body != ""), body)


def unknown_clusters(found: DataFrame, known: DataFrame) -> DataFrame:
    """Clusters that become components: named, of a package URL and coordinates that no known component (purl) has, the first of equal package URLs."""
    named = found.filter("name <> ''").withColumn("key", bare(F.col("purl")))
    have = known.filter("purl <> ''")
    new = named.join(have.select(bare(F.col("purl")).alias("key")).distinct(), "key", "left_anti")
    new = new.withColumn("coordinates", coordinates(F.col("purl"))).join(have.select(coordinates(F.col("purl")).alias("coordinates")).distinct(), "coordinates", "left_anti")
    first = new.groupBy("key").agg(F.min(F.struct("place", "root")).alias("first"))
    kept = new.join(first, "key").filter("place = first.place AND root = first.root")
    ref = F.regexp_replace(F.concat_ws("-", "kind", "name", "version"), "[^A-Za-z0-9.-]", "-")
    return kept.select(F.concat(F.lit("cluster-"), ref).alias("bom_ref"), F.when(F.col("kind").isin(*APPLICATIONS), "application").otherwise("library").alias("ctype"), *found.columns)


def package_root(path: Column) -> Column:
    """The directory that a package's manifest stands in; null for other files."""
    base = P.basename(path)
    return F.when((base.isin(*MANIFESTS) | base.endswith(".gemspec")) & path.contains("/"), P.parent(path))


def redundant(files: DataFrame, known: DataFrame) -> DataFrame:
    """path of the files that known paths name, or that lie in (or are) the directory of a known package's manifest.

    One equi-join on the ways up; no file meets more than its own ancestors.
    """
    paths = known.select(normal(F.col("path")).alias("path")).filter("path IS NOT NULL").distinct()
    index = paths.select(F.lit("file").alias("what"), F.col("path").alias("at")).unionByName(paths.select(F.lit("folder").alias("what"), package_root(F.col("path")).alias("at")).filter("at IS NOT NULL").distinct())
    here = normal(F.col("path"))
    ways = F.array_append(F.transform(enclosing(here), lambda d: F.struct(F.lit("folder").alias("what"), d.alias("at"))), F.struct(F.lit("file").alias("what"), here.alias("at")))
    return files.select("path", F.explode(ways).alias("w")).select("path", "w.*").join(index, ["what", "at"], "left_semi").select("path").distinct()


def decided(files: DataFrame, roots: DataFrame, known: DataFrame, rules: list[tuple] = (), include_redundant: bool = False, include_noise: bool = False) -> DataFrame:
    """Files (ord, path, head, size) -> with cluster (root or ''), rule, category, decision and bypass.

    The first that holds decides: a cluster's file, redundant, documentation, a path rule, a category that gives no component; else it is added.
    What `include_*` lets pass keeps its reason as bypass; a reason ends the look for further ones but for documentation's own drop.
    """
    held = held_by(files, roots).withColumnRenamed("root", "cluster")
    known_as = redundant(files, known).withColumn("redundant", F.lit(True))
    rows = images.classified(files, list(rules)).join(held, "path", "left").join(known_as, "path", "left")
    rows = rows.withColumns({"cluster": F.coalesce("cluster", F.lit("")), "redundant": F.coalesce("redundant", F.lit(False)), "documentation": images.documentation(F.col("path")), "category": untracked.category(F.col("path"), F.col("head"))})
    lets = {"redundant": include_redundant, "noise": include_noise}
    reason = F.when(F.col("redundant"), "redundant").when(F.col("documentation"), "noise").otherwise("")
    marked = F.when(F.col("action") == NOISE, F.concat(F.lit("noise:"), "rule")).when(F.col("action") == REDUNDANT, F.concat(F.lit("redundant:"), "rule")).otherwise("")
    decision = (
        F.when(F.col("cluster") != "", "cluster")
        .when(F.col("redundant") & ~F.lit(lets["redundant"]), "redundant")
        .when(F.col("documentation") & ~F.lit(lets["noise"]), "noise")
        .when((reason == "") & F.col("action").isin(*DROPS), "rule")
        .when((reason == "") & (F.col("action") == NOISE) & ~F.lit(lets["noise"]), "noise")
        .when((reason == "") & (F.col("action") == REDUNDANT) & ~F.lit(lets["redundant"]), "redundant")
        .when(F.col("category").isin(*untracked.DROPPED), "classifier")
        .otherwise("added")
    )
    bypass = F.when(F.col("decision") == "added", F.when(reason != "", reason).otherwise(marked)).otherwise("")
    told = rows.withColumn("decision", decision).withColumn("bypass", bypass)
    # a rule counts where it is asked: not for files that another reason has decided
    asked = (F.col("cluster") == "") & (reason == "") & F.col("action").isin(*DROPS, NOISE, REDUNDANT)
    counts = F.when(asked & ~((F.col("action") == NOISE) & ~F.lit(lets["noise"])) & ~((F.col("action") == REDUNDANT) & ~F.lit(lets["redundant"])), F.col("rule")).otherwise("")
    return told.withColumn("rule", counts).withColumn("said", F.when(asked, F.col("action")).otherwise("")).select(*files.columns, "cluster", "rule", "category", "decision", "bypass", "redundant", "documentation", "said")


def counters(decisions: DataFrame) -> list[Column]:
    """Counters of a scan, for an aggregation or DataFrame.observe(): files that another reason dropped before aren't counted again."""
    free = F.col("cluster") == ""
    noisy = free & ((F.col("documentation") & (F.col("decision") != "redundant")) | (F.col("said") == NOISE))
    stale = free & (F.col("redundant") | (F.col("said") == REDUNDANT))
    of = lambda d: F.count_if(F.col("decision") == d)
    return [F.count("*").alias("scanned"), of("added").alias("added"), F.count_if(stale).alias("redundant"), F.count_if(noisy).alias("noise"), of("classifier").alias("by_classifier"), of("rule").alias("by_rule"), of("cluster").alias("by_cluster")]


def tally(decisions: DataFrame) -> DataFrame:
    """what (category, rule, cluster), name, n: files added by category, files by rule that counted, files by cluster root; one pass."""
    each = F.array(
        F.when(F.col("decision") == "added", F.struct(F.lit("category").alias("what"), F.col("category").alias("name"))),
        F.when(F.col("rule") != "", F.struct(F.lit("rule").alias("what"), F.col("rule").alias("name"))),
        F.when(F.col("cluster") != "", F.struct(F.lit("cluster").alias("what"), F.col("cluster").alias("name"))),
    )
    return decisions.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("n"))


#: Component types of categories; others are files (fixed values).
CATEGORY_TYPES = {"executable": "application", "library": "library", "script": "application"}


def components(decisions: DataFrame) -> DataFrame:
    """Added files (with `digest`, SHA-256 in hexadecimal) as components: ord, bom_ref, ctype, name, location, category, bypass."""
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORY_TYPES.items() for x in pair])
    return decisions.filter("decision = 'added'").select("ord", F.concat(F.lit("untracked-"), F.left("digest", F.lit(12))).alias("bom_ref"), F.coalesce(F.try_element_at(kinds, F.col("category")), F.lit("file")).alias("ctype"), P.basename(F.col("path")).alias("name"), F.col("path").alias("location"), "category", "bypass")


def with_identity(found: DataFrame, identities: DataFrame) -> DataFrame:
    """Components with what their contents state (bom_ref, name, version, purl, vendor, source): a stated text takes the place of the component's own; Java archives are libraries."""
    own = identities.select("bom_ref", *[F.col(c).alias(f"stated_{c}") for c in ("name", "version", "purl", "vendor", "source")])
    stated = lambda c: F.when(F.col(f"stated_{c}") != "", F.col(f"stated_{c}"))
    rows = found.join(own, "bom_ref", "left")
    return rows.select("ord", "bom_ref", F.when(F.col("stated_source") == "java", "library").otherwise(F.col("ctype")).alias("ctype"), F.coalesce(stated("name"), F.col("name")).alias("name"), *[F.coalesce(stated(c), F.lit("")).alias(a) for c, a in (("version", "version"), ("purl", "purl"), ("vendor", "supplier"))], "location", "category", "bypass")
