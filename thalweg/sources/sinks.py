"""Sinks: checked tables with a manifest, upserts, shards, ledgers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import contract_issues


def fingerprint(df: DataFrame) -> str:
    """SHA-256 of a table whatever the order of its rows: of the sum of the rows' hashes, and their number."""
    rows = df.select(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]).cast("decimal(38,0)").alias("h"))
    return rows.agg(F.sha2(F.concat_ws("|", F.lit(",".join(df.columns)), F.count("*").cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string")), 256)).first()[0]


def write_checked(df: DataFrame, path: str, primary_key: list[str], allowed: dict[str, list] | None = None, finite: tuple[str, ...] = (), parameters: dict | None = None) -> dict:
    """Writes a table that meets its contract, with its manifest beside it; raises otherwise, and writes nothing."""
    failed = {r.check: r.failures for r in contract_issues(df, primary_key, allowed, finite).where("failures > 0").collect()}
    if failed:
        raise ValueError(f"the table breaks its contract: {failed}")
    spark = df.sparkSession
    manifest = {"columns": dict(df.dtypes), "primary_key": primary_key, "parameters": parameters or {}, "status": "writing"}

    def note() -> None:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")

    note()  # a job that dies on the way leaves a table that is not valid
    df.write.mode("overwrite").parquet(path)
    manifest |= {"fingerprint": fingerprint(spark.read.parquet(path)), "status": "complete"}
    note()
    return manifest


def verify(spark: SparkSession, path: str) -> bool:
    """Whether a table is still as its manifest says."""
    manifest = json.loads(spark.read.text(f"{path}.manifest").first()[0])
    return manifest["status"] == "complete" and manifest.get("fingerprint") == fingerprint(spark.read.parquet(path))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not new, and the new rows; null keys are one key."""
    same = None
    for k in keys:
        cond = old[k].eqNullSafe(new[k])
        same = cond if same is None else same & cond
    return old.join(new, same, "left_anti").unionByName(new)


def merged_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of shards of one schema; a key in two shards raises when it is read."""
    if len({tuple(s.dtypes) for s in shards}) != 1:
        raise ValueError("the shards' schemas differ")
    out = shards[0].withColumn("_s", F.lit(0))
    for k, s in enumerate(shards[1:], 1):
        out = out.unionByName(s.withColumn("_s", F.lit(k)))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    twice = F.max("_s").over(w) != F.min("_s").over(w)
    return out.withColumn("_b", F.when(twice, F.raise_error(F.lit("a key is in two shards")).cast("int"))).where(F.col("_b").isNull()).drop("_s", "_b")


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends rows as JSON objects, one a line, in files of their own: writers never meet."""
    df.write.mode("append").json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that the rows have."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
