"""Results of static analysis: four rules on components, each for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule numbers, levels, confidence under which a CPE name counts as low.
UNTRACKED, UNKNOWN_ORIGIN, NO_CPE, LOW_CONFIDENCE = "001", "002", "003", "004"
LEAST_CONFIDENCE = 0.70


def label(name: Column, version: Column, purl: Column, bom_ref: Column) -> Column:
    """What a component is called: name and version, name, package URL, reference."""
    return F.when((name != "") & (version != ""), F.concat_ws("@", name, version)).when(name != "", name).when(purl != "", purl).otherwise(bom_ref)


#: Rules: number, name, what it says, and what finds it.
RULES = (
    (UNTRACKED, "UntrackedComponent", "A component that a scan found and the document did not list.", "untracked-scan"),
    (UNKNOWN_ORIGIN, "OriginUnknown", "A component that belongs to neither the base image nor the application for sure.", "basediff"),
    (NO_CPE, "MissingCPE", "A component with a package URL and no CPE name, which scanners are likely to miss.", "cpe"),
    (LOW_CONFIDENCE, "LowConfidenceCPE", "A CPE name that was guessed and should be looked at.", "cpe"),
)


def quoted(value: Column) -> Column:
    """In double quotes, with quotes, backslashes and common control characters escaped."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), value, F.lit('"'))


def found(components: DataFrame, *keys: str) -> DataFrame:
    """keys, bom_ref, rule, level, message, paths: a row for each rule that fits a component.

    Takes origin, method, category, confidence (texts), cpe and places (paths) beside a component's own columns.
    Nulls count as empty. The texts of messages are fixed values.
    """
    texts = {x: F.coalesce(components[x], F.lit("")) for x in ("bom_ref", "name", "version", "purl", "cpe", "origin", "method", "category", "confidence")}
    own = quoted(label(texts["name"], texts["version"], texts["purl"], texts["bom_ref"]))
    places = F.coalesce(components["places"], F.array().cast("array<string>"))
    what = F.when(texts["category"] != "", texts["category"]).otherwise("component")
    at = F.when(F.coalesce(F.get(places, F.lit(0)), F.lit("")) != "", F.concat(F.lit(" found at "), F.get(places, F.lit(0)))).otherwise("")
    number = components["confidence"].try_cast("double")
    rules = [
        (UNTRACKED, "warning", (texts["method"] == "untracked-scan") | (texts["category"] != ""), F.concat(F.lit("Untracked "), what, F.lit(" "), own, at, F.lit("."))),
        (UNKNOWN_ORIGIN, "note", texts["origin"] == "unknown", F.concat(F.lit("Component "), own, F.lit(" has Origin=unknown."))),
        (NO_CPE, "note", (texts["purl"] != "") & (texts["cpe"] == ""), F.concat(F.lit("Component "), own, F.lit(" (PURL "), quoted(texts["purl"]), F.lit(") has no CPE."))),
        (LOW_CONFIDENCE, "note", (texts["confidence"] == "low") | F.coalesce(number < LEAST_CONFIDENCE, F.lit(False)), F.concat(F.lit("Component "), own, F.lit(" has a low-confidence CPE (heuristic)."))),
    ]
    row = lambda rule, level, fits, text: F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), text.alias("message")))
    hits = F.filter(F.array(*[row(*r) for r in rules]), lambda r: r.isNotNull())
    paths = F.transform(places, lambda p: F.regexp_replace(p, "^/", ""))
    return components.select(*[components[k] for k in keys], texts["bom_ref"].alias("bom_ref"), paths.alias("paths"), F.explode(hits).alias("r")).select(*keys, "bom_ref", "r.*", "paths")


def results(components: DataFrame) -> DataFrame:
    """bom_ref, rule, level, message, locations (joined by commas): a component without places is located by its reference, at none without one."""
    located = F.when(F.size("paths") > 0, F.array_join("paths", ",")).otherwise(F.col("bom_ref"))
    return found(components).select("bom_ref", "rule", "level", "message", located.alias("locations"))
