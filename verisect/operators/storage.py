"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Where that is unset on one machine, a temporary folder
    is made; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A new name in the application's folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. To be called when what was made from them is written:
    frames that are still to be read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to a new folder that all executors share and read it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def compiled_in_parts(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what Spark would compile to one method of more than 8000 bytes, which the JVM only interprets, is
    compiled to smaller ones. For plans of many expressions, around the action that runs them."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Columns that keep a row's place: its partition, and its number within.
PLACE = ("__p", "__i")


def placed(df: DataFrame) -> DataFrame:
    """Adds a row's place in the frame as it is laid out."""
    return df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def numbered(rows: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Running numbers from start for rows of placed(), without a window over everything: each partition
    starts where those before it end. rows is read twice and must be laid out alike both times: a stored
    frame, or a scan of files."""
    spark = rows.sparkSession
    firsts, seen = [], start
    for r in rows.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():  # a row for each partition
        firsts.append((r["__p"], seen))
        seen += r["n"]
    if not firsts:
        return rows.withColumn(name, F.lit(None).cast("long")).drop(*PLACE)
    offsets = F.broadcast(spark.createDataFrame(firsts, "__p int, __first long"))
    return rows.join(offsets, "__p").withColumn(name, F.col("__first") + F.col("__i")).drop("__first", *PLACE)


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame of a few values a row, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
