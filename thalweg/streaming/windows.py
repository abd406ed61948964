"""Streaming twins of the windowed aggregates. Event time must be a timestamp; sources with a publication delay get it as their watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

WEEK = ("7 days", "7 days", "4 days")  # the epoch was a Thursday: four days on begins a Monday


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet table as a stream, ``files`` files a trigger."""
    schema = spark.read.parquet(path).schema
    is_file = path.endswith(".parquet") and spark.read.parquet(path).inputFiles() == [spark.read.parquet(path).inputFiles()[0]]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", path.rsplit("/", 1)[1] if is_file else "*").parquet(path.rsplit("/", 1)[0] if is_file else path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 day") -> DataFrame:
    """(start, keys, n, total, mean) of each window."""
    return df.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "total", "mean")


def weekly(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """Weeks from Monday to Sunday, named by their Sunday."""
    rows = df.groupBy(F.window(ts, *WEEK).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.date_sub(F.col("w.end").cast("date"), 1).alias("week_end"), *keys, "n", "mean")


def monthly(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """(month, keys, n, mean); months are no windows of one length, so they are grouped by their first day."""
    return df.groupBy(F.trunc(ts, "month").alias("month"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def sliding(df: DataFrame, ts: str, keys: list[str], value: str, size: str = "5 days", step: str = "1 day") -> DataFrame:
    rows = df.groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), *keys, "total")


def sessions(df: DataFrame, ts: str, keys: list[str], value: str, limit: float, gap: str) -> DataFrame:
    """(start, end, keys, n, top): runs of values over a limit that pause for less than ``gap``."""
    rows = df.where(F.col(value) > limit).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "top")


def latest_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def open_runs(df: DataFrame, key: str, ts: str, value: str, limit: float) -> DataFrame:
    """(key, run, n, top): runs of consecutive rows over a limit that are closed by a row at or under it; a run may span batches.

    Rows of a batch are taken in the order of their time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, n, top = state.get if state.exists else (0, 0, 0.0)
        values = pd.concat([b[[ts, value]] for b in batches]).sort_values(ts, kind="stable")[value].to_numpy(float)
        values = np.r_[np.full(n, top), values]  # the open run goes on in front of the batch
        on = values > limit
        edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
        starts, ends = edges[::2], edges[1::2]
        tops = np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0)
        still = bool(len(ends)) and ends[-1] == len(values)
        closed = len(starts) - still
        state.update((run + closed, int(ends[-1] - starts[-1]) if still else 0, float(tops[-1]) if still else 0.0))
        yield pd.DataFrame({key: [k[0]] * closed, "run": np.arange(run, run + closed), "n": (ends - starts)[:closed], "top": tops[:closed]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, run long, n long, top double", "run long, n long, top double", "append", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; without one, in local mode, one of this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        top = tempfile.mkdtemp(prefix="thalweg-")
    return top.rstrip("/")


def drained(stream: DataFrame, mode: str, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there now; the rows that it has at the end, from Parquet files in the shared folder.

    A batch is written under its number, so a batch that is run again writes over itself. Appended rows are
    those of all batches, a complete result that of the last.
    """
    from uuid import uuid4

    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/drained-{uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{top}/rows/b={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{top}/rows") if query.lastProgress else spark.createDataFrame([], schema)
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        rows = rows.where(F.col("_batch") == F.lit(last))
    rows = rows.drop("_batch")
    return fold(rows) if fold else rows
