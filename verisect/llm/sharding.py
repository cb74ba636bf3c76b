"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, doc_id), so equal texts are neighbours. A sample that
favours large records gives key quantiles by bytes; these splitters cut the key space into many small
ranges. The exact bytes of each range are then counted, ranges that came out overfull (one key may hold
a third of all rows) are subdivided by a hash of the row, and consecutive ranges are packed into shards
of near equal bytes. Places within a shard come from per-range counts and a rank within each range, so
no task ever holds a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import stored, table

#: Bytes that each record takes beside its text.
OVERHEAD = 8


def keyed(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, and the key (k1, k2) with a row number rid that tells equal keys apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2"),
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"),
    )


def splitters(rows: DataFrame, total: int, ranges: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ranges - 1 keys that cut the rows into ranges of about equal bytes.

    A row is drawn with a probability in proportion to its size, so about sample_rows of them (the bound)
    reach the driver; one that is larger than the drawing step counts by its size.
    """
    step = max(1, total // sample_rows)
    u = F.pmod(F.xxhash64(F.lit("splitters"), "k1", "k2"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(u * step < F.col("size")).select("k1", "k2", F.greatest("size", F.lit(step)).alias("w")).collect()
    drawn.sort()
    reached = np.cumsum([float(r.w) for r in drawn])
    cuts = np.searchsorted(reached, np.arange(1, ranges) * (reached[-1] / ranges)) if len(drawn) else []
    keys = sorted({(drawn[i].k1, drawn[i].k2) for i in cuts if i < len(drawn)})
    return np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)


def _range_of(k1: np.ndarray, k2: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """The number of splitters that are at most the key."""
    low, high = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(s2[low[i] : high[i]], k2[i], "right")
    return low


def assign(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 48, range_rows: int = 500_000, sample_per_range: int = 24) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot.

    shard: from 0, of near equal bytes; slot: from 0 without gaps in a shard. A null text has no bytes
    (crc 0) and, like a null doc_id, is a key as any other. Repeated rows each get a slot. An empty table
    gives an empty result; other columns are not looked at. A record is never split, so one that is larger
    than a shard's share makes its shard larger. Ranges grow in number with the rows.
    """
    return placed(keyed(docs), shards, ranges_per_shard, range_rows, sample_per_range).drop("rid")


def placed(keys: DataFrame, shards: int = 24, ranges_per_shard: int = 48, range_rows: int = 500_000, sample_per_range: int = 24) -> DataFrame:
    """assign for rows that are keyed already, with their rid."""
    spark = keys.sparkSession
    rows = stored(keys)
    all_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * ranges_per_shard, math.ceil(all_rows / range_rows))
    s1, s2 = splitters(rows, total, ranges, ranges * sample_per_range)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_range_of(k1, k2, s1, s2), pa.int32())], [*b.schema.names, "range"])

    ranged = stored(rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, k1 long, k2 long, rid long, range int"))
    share = max(1, total / ranges)
    size_of = lambda df, *by: {tuple(r[c] for c in by): (r.n, r.b) for r in df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    # one row per range; at most the number of ranges
    parts = {k[0]: math.ceil(b / share) for k, (n, b) in size_of(ranged, "range").items() if n > 1 and b > 2 * share}
    if parts:
        over = F.broadcast(spark.createDataFrame(list(parts.items()), "range int, parts int"))
        ranged = ranged.join(over, "range", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("k1", "k2", "rid"), F.col("parts"))).cast("int")).drop("parts")
    else:
        ranged = ranged.withColumn("part", F.lit(0))
    # at most ranges + total / share pieces, so at most twice the ranges
    pieces = sorted(size_of(ranged, "range", "part").items())
    laid, before, counts = [], 0, [0] * shards
    for (r, p), (n, b) in pieces:
        shard = min(shards - 1, int(shards * (before + b / 2) / total))
        laid.append((r, p, shard, counts[shard]))
        counts[shard] += n
        before += b
    plan = F.broadcast(spark.createDataFrame(laid, "range int, part int, shard int, first long"))
    rank = F.row_number().over(Window.partitionBy("range", "part").orderBy("k1", "k2", "rid")) - 1
    return ranged.withColumn("rank", rank).join(plan, ["range", "part"]).select("rid", "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> str:
    """Write docs as Parquet with one folder per shard, ordered by slot; returns the name of the folders'
    column: ``shard``, with underscores before it if docs has such a column.

    Every row goes to the place that it was given, also one with a null id or text, or one that is there
    more than once. An empty table gives an empty folder.
    """
    folder = "shard"
    while folder in docs.columns:
        folder = "_" + folder
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")))
    places = placed(keyed(rows.select("row.doc_id", "row.text", "rid"), F.col("rid")), **options).select("rid", "shard", "slot")
    dealt = rows.join(places, "rid").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return folder


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in 24 shards of near equal bytes."""
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
