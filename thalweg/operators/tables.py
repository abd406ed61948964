"""Operators on result tables: shares, composites, quantiles, audits, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(df: DataFrame, keys: list[str], value: str, percent: bool = False) -> DataFrame:
    """Adds share of the group's total; null for a total of 0."""
    part = F.try_divide(F.col(value), F.nullif(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0.0)))
    return df.withColumn("share", part * 100 if percent else part)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], least: int = 1) -> DataFrame:
    """(keys, n, one column a share): linear quantiles in one pass, null under ``least`` values."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.when(F.count(value) >= least, F.percentile(value, F.lit(s))).alias(name) for name, s in shares.items()])


def robust_scales(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mad, l1): 1.4826 times the median deviation, and the mean one times the root of pi / 2."""
    import math

    centre = df.groupBy(*keys).agg(F.median(value).alias("median"))
    joined = df.join(centre, keys) if keys else df.crossJoin(F.broadcast(centre))
    dev = F.abs(F.col(value) - F.col("median"))
    return joined.groupBy(*keys, "median").agg((F.median(dev) * 1.4826).alias("mad"), (F.avg(dev) * math.sqrt(math.pi / 2)).alias("l1"))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """(keys, quantile): at midpoints of the cumulated weights, linear between them, clamped at the ends."""
    w = Window.partitionBy(*keys).orderBy(value, weight)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("_p", (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2) / total)
    rows = rows.withColumn("_np", F.lead("_p").over(w)).withColumn("_nv", F.lead(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    at = F.when((F.col("_p") <= q) & (F.col("_np") > q), F.col(value) + (F.col("_nv") - F.col(value)) * (q - F.col("_p")) / (F.col("_np") - F.col("_p"))).when(F.col("_first") & (F.col("_p") > q), F.col(value)).when(F.col("_np").isNull() & (F.col("_p") <= q), F.col(value))
    return rows.groupBy(*keys).agg(F.max(at).alias("quantile"))


def composite(df: DataFrame, event: str, step: str, value: str) -> DataFrame:
    """(step, n, mean, median, q25, q75) over events, of each event's mean."""
    each = df.groupBy(event, step).agg(F.avg(value).alias("_v"))
    return each.groupBy(step).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.median("_v").alias("median"), F.percentile("_v", F.lit(0.25)).alias("q25"), F.percentile("_v", F.lit(0.75)).alias("q75"))


def temporal_audit(df: DataFrame, time: str, keys: tuple[str, ...] = (), step_days: int = 1) -> DataFrame:
    """(keys, n, first, last, duplicates, missing, is_regular) of a time axis."""
    each = df.groupBy(*keys, time).agg(F.count("*").alias("_c"))
    out = each.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.sum(F.col("_c") - 1).alias("duplicates"), F.count("*").alias("_d"))
    missing = (F.datediff("last", "first") / step_days + 1).cast("long") - F.col("_d")
    return out.withColumn("missing", missing).withColumn("is_regular", (F.col("missing") == 0) & (F.col("duplicates") == 0)).drop("_d")


def contract_issues(df: DataFrame, primary_key: list[str], allowed: dict[str, list] | None = None, finite: tuple[str, ...] = ()) -> DataFrame:
    """(check, failures): duplicate keys, null keys, values that are not allowed, infinities. One pass and one aggregation by key."""
    checks: list[tuple[str, Column]] = [(f"null:{c}", F.count_if(F.col(c).isNull())) for c in primary_key]
    checks += [(f"allowed:{c}", F.count_if(~F.col(c).isin(v))) for c, v in (allowed or {}).items()]
    checks += [(f"finite:{c}", F.count_if(F.abs(c) == float("inf"))) for c in finite]
    one = df.agg(*[e.alias(n) for n, e in checks])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("failures")) for n, _ in checks])).alias("c")).select("c.*")
    twice = df.groupBy(*primary_key).count().where("count > 1").agg(F.count("*").alias("failures")).select(F.lit("duplicate_key").alias("check"), "failures")
    return rows.unionByName(twice)


def unpivoted(df: DataFrame, keys: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value)


def redundancy_filter(df: DataFrame, columns: list[str], limit: float) -> list[str]:
    """Columns in order, without those whose absolute correlation with one kept before is ``limit`` or more. One aggregation over all pairs."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    r = df.agg(*[F.corr(columns[i], columns[j]).alias(f"{i}_{j}") for i, j in pairs]).first() if pairs else {}
    kept: list[int] = []
    for i in range(len(columns)):
        if all(abs(r[f"{i}_{j}"] or 0.0) < limit for j in kept):
            kept.append(i)
    return [columns[i] for i in kept]
