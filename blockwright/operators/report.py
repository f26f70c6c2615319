"""Reporting: reshaping and summaries of measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_fill(*frames: DataFrame, fill: dict | None = None) -> DataFrame:
    """Union by name; missing columns are null, or what ``fill`` says."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(fill) if fill else out


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.median(v).alias("median"), F.percentile(v, F.lit(0.1)).alias("q10"), F.percentile(v, F.lit(0.9)).alias("q90"),
    )


def longer(rows: DataFrame, keep: list[str], values: list[str], name: str = "name", value: str = "value", prefix: str = "") -> DataFrame:
    out = rows.unpivot(keep, values, name, value)
    return out.withColumn(name, F.regexp_replace(name, f"^{prefix}", "")) if prefix else out


def wider(rows: DataFrame, keep: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Names are given, so no pass is needed to find them."""
    return rows.groupBy(*keep).pivot(name, names).agg(F.first(value, ignorenulls=True))


def two_stage(rows: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean per inner group, then mean and maximum per outer group."""
    first = rows.groupBy(*inner).agg(F.avg(value).alias("_m"))
    return first.groupBy(*outer).agg(F.avg("_m").alias("mean"), F.max("_m").alias("high"))


def slowdown(rows: DataFrame, keys: list[str], switch: str, value: str) -> DataFrame:
    """Self join of the rows with the switch on and off: ratio per key."""
    on = rows.where(F.col(switch)).select(*keys, F.col(value).alias(f"{value}_on"))
    off = rows.where(~F.col(switch)).select(*keys, F.col(value).alias(f"{value}_off"))
    return on.join(off, keys).withColumn("ratio", F.col(f"{value}_on") / F.col(f"{value}_off"))


def recode(column: str, names: dict[str, str]):
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def check(rows: DataFrame, **conditions: str) -> None:
    """Raises for conditions that a row violates; one pass for all of them."""
    counts = rows.agg(*(F.count_if(~F.expr(c)).alias(name) for name, c in conditions.items())).head()
    broken = [name for name in conditions if counts[name]]
    if broken:
        raise ValueError(f"violated: {broken}")
