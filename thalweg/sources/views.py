"""Logical views over the served tables: the shapes that the climate operators work on.

Each view has a DataFrame form and, for the comparison with DuckDB, the same definition as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, x): one value a day, with gaps."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("x"))


def cube_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, pixel_id, region, lat, lon, v): a daily field on 25 cells."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    cells = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    rows = line.join(cells, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(F.to_date("l_shipdate").alias("d"), F.col("n_nationkey").alias("pixel_id"), F.col("n_regionkey").alias("region")).agg(F.sum("l_quantity").alias("v"))
    return sums.select("d", "pixel_id", "region", (F.col("region") * 5.0 - 10.0).alias("lat"), F.pmod(F.col("pixel_id") * 14.4 + 120.0, F.lit(360.0)).alias("lon"), "v")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, depth_m, t): ragged profiles, one value a depth."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("profile_id"), (F.col("l_linenumber") * 10.0).alias("depth_m")).agg(F.avg("l_quantity").alias("t"))


def monthly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, m): monthly means of the daily signal."""
    return signal_daily(spark, sf_dir).groupBy(F.trunc("d", "month").alias("month")).agg(F.avg("x").alias("m"))


SIGNAL = "signal AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1)"
CUBE = """cube AS (SELECT CAST(l_shipdate AS DATE) AS d, n_nationkey AS pixel_id, n_regionkey AS region, n_regionkey * 5.0::DOUBLE - 10.0 AS lat,
  fmod(n_nationkey * 14.4::DOUBLE + 120.0, 360.0) AS lon, sum(l_quantity) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
PROFILES = "profiles AS (SELECT l_orderkey AS profile_id, l_linenumber * 10.0::DOUBLE AS depth_m, avg(l_quantity) AS t FROM lineitem GROUP BY ALL)"
MONTHLY = f"{SIGNAL}, monthly AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, avg(x) AS m FROM signal GROUP BY 1)"
