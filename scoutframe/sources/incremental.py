"""Reading only what is new: a watermark table beside the data says which files were taken in, and when changed.

A file is new when its path is not listed or was changed since. Spark prunes files
by modification time before opening them; files as old as the newest listed one
are told apart by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

STATE = "file string, modified timestamp, rows long, batch long"


def file_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def taken_in(spark: SparkSession, state: str) -> DataFrame:
    """(file, modified, rows, batch) of all batches so far."""
    return spark.read.schema(STATE).parquet(state) if file_exists(spark, state) else spark.createDataFrame([], STATE)


def read_new(spark: SparkSession, read: Callable[[str], DataFrame], path: str, state: str) -> tuple[DataFrame, int]:
    """Rows of files that are new or changed since they were listed in ``state``, and the number of this batch.

    ``read`` makes a file-source DataFrame of a path. The rows are stored, so they
    are the same when used again, and have ``_file`` and ``_modified``; pass them to
    ``take_in`` once they have been used. A file changed again later is new again.
    """
    seen = taken_in(spark, state)
    last = seen.agg(F.max("modified"), F.max("batch")).first()
    rows = read(path)
    rows = rows.select(
        *rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified")
    )
    if last[0] is not None:
        rows = rows.where(F.col("_modified") >= F.lit(last[0]))
        at_edge = seen.where(F.col("modified") == F.lit(last[0])).select(
            F.col("file").alias("_file"), F.col("modified").alias("_modified")
        )
        rows = rows.join(at_edge, ["_file", "_modified"], "left_anti")
    return cut_lineage(rows), (last[1] or 0) + 1


def take_in(rows: DataFrame, batch: int, state: str) -> None:
    """Append the files of ``rows`` to the watermark table."""
    rows.groupBy(F.col("_file").alias("file"), F.col("_modified").alias("modified")).agg(
        F.count(F.lit(1)).alias("rows")
    ).withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(state)
