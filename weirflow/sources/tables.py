"""Sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of an events folder, for streams, which never infer.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive in files."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return read.withColumn("ok", F.col("event_type") != "error")


def after(df: DataFrame, order: str, cursor, limit: int | None = None) -> DataFrame:
    """The next page of a table behind a cursor; the filter reaches the scan."""
    rows = df if cursor is None else df.where(F.col(order) > F.lit(cursor))
    return rows.orderBy(order).limit(limit) if limit else rows


def insert_new(target: DataFrame | None, rows: DataFrame, keys: list[str], path: str) -> int:
    """Appends rows whose key is neither in the target nor twice among them, and gives how many; null is a key like any other.

    The rows are written to a folder beside the table first and then moved in, so a failed insert adds none of them.
    """
    fresh = rows.dropDuplicates(keys)
    if target is not None:
        known = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        fresh = fresh.join(known, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti")
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    staged, into = jvm.Path(f"{path.rstrip('/')}__new-{uuid.uuid4().hex}"), jvm.Path(path)
    fs = into.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        fresh.write.parquet(staged.toString())
        n = spark.read.schema(fresh.schema).parquet(staged.toString()).count()
        fs.mkdirs(into)
        for status in fs.listStatus(staged):
            if status.getPath().getName().startswith("part-"):
                fs.rename(status.getPath(), jvm.Path(into, status.getPath().getName()))
    finally:
        fs.delete(staged, True)
    return n
