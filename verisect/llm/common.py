"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every contract that counts or shingles words.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; where that is unset on one machine (tests), a temporary
    folder is made and set as the checkpoint folder of the context. On a cluster it must be set.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: computed once, and lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if more than one in so many rows has it, so at most so many keys are hot.
HOT_KEYS = 1000


def joined(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with the columns of found but ``n``; found has one row for each key, and n says how many of rows
    have it. Hot keys, of which there can't be more than HOT_KEYS, are joined by broadcast, so their rows
    stay where they are; found is read twice."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot, cold = found.filter(F.col("n") * HOT_KEYS > total).drop("n"), found.filter(F.col("n") * HOT_KEYS <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


#: Rows that a key must have to be split, and the parts that it is split into.
HOT_ROWS, SALTS = 1000, 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that more than HOT_ROWS rows and more than one row in HOT_KEYS have, so fewer than HOT_KEYS;
    None if there are none. rows is read twice.

    They stay a table: a frame made of local rows starts a Python daemon and workers of their own on each executor.
    """
    least = max(HOT_ROWS, rows.count() / HOT_KEYS)
    found = stored(rows.groupBy(key).count().filter(F.col("count") > least).select(key))
    return found if found.limit(1).count() else None


def salted(rows: DataFrame, found: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with found, which has at most one row for each key. The rows of the keys in hot (one
    column) are dealt to SALTS parts by another column; only those keys' rows of found are repeated."""
    if hot is None:
        return rows.join(found, key)
    mark = F.broadcast(hot.toDF(key).withColumn("__hot", F.lit(True)))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(mark, key, "left").withColumn("__part", part).drop("__hot")
    right = found.join(mark, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [key, "__part"]).drop("__part")


#: Rows of a few numbers each that are broadcast at most.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame of a few numbers a row, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of text that go to a Python worker at once. Texts are long, so Spark's 10,000 would take much memory.
TEXT_BATCH = 1000


def over_texts(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over rows that hold texts, in small batches; the setting stays with the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_BATCH:
        conf.set(name, str(TEXT_BATCH))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
