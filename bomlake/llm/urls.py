"""URL filtering by association rules, on DataFrame functions and Spark's FP-growth.

Stated rules (host and path prefix) decide the URLs they fit; the longest wins. All others are judged by
association rules. Labels are the stated rules' verdicts and, as weak labels, `block` for hosts with one of the
`seeds` among their words (a parameter: words that hosts of unwanted sites go by). FP-growth mines token combinations
that go with a label, URLs without one counting as neither; rules are pruned by support, by a lower bound of
their confidence (so that few URLs in accord by chance make no rule), lift and by more general rules that are as sure,
and match through an inverted index from each rule's rarest token. Rules are mined from all URLs. Of tokens that the
same rows have, one stands for all, so that a URL with many copies doesn't multiply the combinations.

Defined results: a null URL, or one without '://', has an empty host and path, no rule and the method's
verdict on no tokens, allow; rows that repeat are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least support, confidence and lift of a rule; most tokens of one.
SUPPORT, CONFIDENCE, LIFT, TOKENS = 0.002, 0.8, 1.2, 3
#: Standard deviations that the lower bound of a confidence lies below it.
SURE = 1.64
#: Words of hosts that are blocked as weak labels.
SEEDS = ("spam", "casino", "pills", "porn", "viagra", "betting")
#: A token that so large a share of the URLs has tells nothing.
COMMON = 0.9


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def stated(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and their words, the top label, path segments, suffix, kind of number, query keys."""

    def named(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: F.length(v) > 0), lambda v: F.concat(F.lit(mark), v))

    segments = F.split(F.translate(path, UPPER, LOWER), "/")
    words = F.filter(segments, lambda s: ~s.rlike(r"^[0-9]+(\.[a-z]+)?$"))
    numbers = F.transform(F.filter(segments, lambda s: s.rlike(r"^[0-9]")), lambda s: F.substring(s, 1, 1))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda q: F.substring_index(q, "=", 1))
    found = F.concat(
        named("host:", F.split(host, r"[.\-]")), named("top:", F.array(F.substring_index(host, ".", -1))), named("path:", words), named("starts:", numbers), named("suffix:", F.array(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))), named("query:", query)
    )
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> list[dict]:
    """(tokens, verdict or null) -> pruned rules: items (rarest first), verdict, confidence, support."""
    n = labelled.count()
    if not n:
        return []
    of_row = F.xxhash64("tokens")
    halves = [F.sum(h).alias(name) for name, h in (("low", of_row.bitwiseAND(0x7FFFFFFF)), ("high", F.shiftrightunsigned(of_row, 33)))]
    counts = labelled.select(F.explode("tokens").alias("t"), "tokens").groupBy("t").agg(F.count("*").alias("n"), *halves).filter(F.col("n") >= support * n)
    rows = counts.collect()  # at most tokens a row / support
    frequent, together = {r.t: r.n for r in rows}, {}
    for r in sorted(rows, key=lambda r: r.t):
        if r.n < COMMON * n:
            together.setdefault((r.n, r.low, r.high), r.t)
    useful = list(together.values())
    if not useful:
        return []
    keep = F.array_intersect("tokens", F.array(*map(F.lit, useful)))
    baskets = labelled.select(F.when(F.col("verdict").isNull(), keep).otherwise(F.array_append(keep, F.concat(F.lit("="), "verdict"))).alias("items"))
    wide = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=wide).fit(baskets)
    found = model.associationRules.filter((F.size("antecedent") <= TOKENS) & (F.col("lift") >= lift) & F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda a: a.startswith("=")))
    rules = [{"items": sorted(r.antecedent, key=lambda t: (frequent[t], t)), "verdict": r.consequent[0][1:], "confidence": r.confidence, "support": r.support} for r in found.collect()]  # bounded by the least support
    rules = [r for r in rules if lower_bound(r["confidence"], r["support"] * n / r["confidence"]) >= confidence]
    rules.sort(key=lambda r: (len(r["items"]), -r["confidence"], r["items"]))
    kept: list[dict] = []
    for r in rules:
        if not any(set(k["items"]) <= set(r["items"]) and k["verdict"] == r["verdict"] and k["confidence"] >= r["confidence"] for k in kept):
            kept.append(r)
    return kept


def lower_bound(confidence: float, n: float, z: float = SURE) -> float:
    """Of a share found among n, by Wilson's interval."""
    middle, spread = confidence + z * z / (2 * n), z * (confidence * (1 - confidence) / n + z * z / (4 * n * n)) ** 0.5
    return (middle - spread) / (1 + z * z / n)


def seeded(host: Column, seeds: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)


def judged(own: Column, rules: list[dict]) -> Column:
    """The verdict of the surest matching rule, block where two are as sure; allow without one."""
    if not rules:
        return F.lit("allow")
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r["items"][0], []).append(r)
    rule = lambda r: F.struct(F.array(*map(F.lit, r["items"])).alias("items"), F.lit(float(r["confidence"])).alias("confidence"), F.lit(r["verdict"]).alias("verdict"))
    index = F.create_map(*[x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*map(rule, rs)))])
    listed = F.flatten(F.filter(F.transform(own, lambda t: F.element_at(index, t)), lambda r: r.isNotNull()))
    fits = F.filter(listed, lambda r: F.size(F.array_except(r["items"], own)) == 0)
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"].alias("c"), r["verdict"].alias("v"))))
    return F.coalesce(best["v"], F.lit("allow"))


def verdicts(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """key, host, path, rule, verdict for every row."""
    base = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("u"))
    host, path = parts(F.col("u"))
    base = base.withColumns({"host": host, "path": path})
    base = base.withColumns({"fit": stated(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("u"), F.col("host"), F.col("path"))})
    label = F.coalesce(F.col("fit.verdict"), F.when(seeded(F.col("host"), seeds), "block"))
    found = mine(materialise(base.select("tokens", label.alias("verdict")), pages.sparkSession))  # several passes
    own = once(F.col("tokens"), lambda t: judged(t, found))
    return base.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"))
