"""Reads lifted as they arrive, against a block map that doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisect.operators import liftover


def lift_reads_stream(reads: DataFrame, blocks: DataFrame, path: str, checkpoint: str, key: str = "rec_no"):
    """Start a query that lifts each micro-batch of reads (key, chr, start_pos, end_pos) and appends the
    loci as Parquet under path; a batch has a folder of its own, so a replayed one replaces itself."""

    def lift(batch: DataFrame, epoch: int) -> None:
        liftover.lift_loci(batch, blocks, key).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return reads.writeStream.foreachBatch(lift).option("checkpointLocation", checkpoint).start()


def lift_points_stream(points: DataFrame, blocks: DataFrame, bits: int = 11) -> DataFrame:
    """A stateless stream-static join: points (rec_no, chr, pos) with the mappable blocks that hold them,
    by bins of the block map, in append mode."""
    b = blocks.filter(liftover.mappable(F.col("feature"))).withColumn("b_end", F.col("src_loc") + F.col("size") - 1)
    binned = b.withColumn("b_bin", F.explode(F.sequence(F.shiftright("src_loc", bits), F.shiftright("b_end", bits))))
    p = points.withColumn("p_bin", F.shiftright("pos", bits))
    hit = p.join(binned, (p["chr"] == binned["src_chr"]) & (p["p_bin"] == binned["b_bin"]) & p["pos"].between(binned["src_loc"], binned["b_end"]))
    loc = F.when(F.col("direction") == "+", F.col("dst_loc") + F.col("pos") - F.col("src_loc")).otherwise(F.col("dst_loc") + F.col("b_end") - F.col("pos"))
    return hit.select("rec_no", F.col("dst_chr").alias("loc_chr"), loc.alias("loc"), "feature", "direction")
