"""Metrics as text in the Prometheus exposition format, a row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """The shortest decimal that reads back as the number, without an exponent from 1e-4 up to 1e19."""
    short = value.cast("double").cast("string")
    plain = F.regexp_replace(F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    size = F.abs(value)
    digits, power = F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(short, F.lit("E"), F.lit(2))
    long = F.concat(digits, F.lit("e"), F.when(power.startswith("-"), "-").otherwise("+"), F.lpad(F.replace(power, F.lit("-"), F.lit("")), F.greatest(F.length(F.replace(power, F.lit("-"), F.lit(""))), F.lit(2)), F.lit("0")))
    return F.when(value == 0, "0").when(F.isnan(value), "NaN").when(size == float("inf"), F.when(value > 0, "+Inf").otherwise("-Inf")).when((size >= 1e-4) & (size < 1e19), plain).otherwise(long)


def escaped(value: Column) -> Column:
    """A label's value: escaped for the format, then quoted."""
    out = value
    for _ in range(2):
        out = F.replace(F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def labels(pairs: dict[str, Column]) -> Column:
    """{name="value",...} in order of names; '' without labels."""
    if not pairs:
        return F.lit("")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f"{n}="), escaped(F.coalesce(pairs[n], F.lit("")))) for n in sorted(pairs)]), F.lit("}"))


def header(name: str, kind: str, text: str) -> list[str]:
    clean = text.replace("\\", "\\\\").replace("\n", "\\n")
    return [f"# HELP {name} {clean}", f"# TYPE {name} {kind}"]


def histogram(series: DataFrame, name: str, label: str, bounds: list[float]) -> DataFrame:
    """(label, le_0.., n, total) -> (label, pos, line): cumulative buckets, sum and count of each series."""
    own = labels({label: F.col("label")})
    rest = lambda le: F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(f',le="{le}"}}'))
    lines = [F.concat(F.lit(f"{name}_bucket"), rest(f"{b:g}"), F.lit(" "), F.col(f"le_{i}")) for i, b in enumerate(bounds)]
    lines += [F.concat(F.lit(f"{name}_bucket"), rest("+Inf"), F.lit(" "), F.col("n")), F.concat(F.lit(f"{name}_sum"), F.col("own"), F.lit(" "), number(F.col("total"))), F.concat(F.lit(f"{name}_count"), F.col("own"), F.lit(" "), F.col("n"))]
    return series.withColumn("own", own).select("label", F.posexplode(F.array(*lines)).alias("pos", "line"))
