"""The folder that all machines of a cluster share, for written stages and archives."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, in local mode one of this machine; on a cluster, whose machines share no such folder, an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        top = tempfile.mkdtemp(prefix="thalweg-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: no lineage to lose with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave. Nothing that is still to be read may need it: its readers are themselves written or collected."""
    spark = table.sparkSession
    hadoop, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    for top in {file.rpartition("/")[0] for file in table.inputFiles()}:
        folder = hadoop(uri(top))
        if not re.search("-[0-9a-f]{32}$", folder.getName()):
            raise ValueError(f"{folder} was not made by written")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
