"""Coordinate lifting through a block map.

A block map has one row per block: size, src_chr, src_loc, dst_chr, dst_loc, direction, feature and (for
order) block_no; places are 1-based. All joins are range joins on bins, or a lookup of the next block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import interval_join, merge_intervals
from verisect.operators.scan import in_order, scanned

MIN_READ_OVERLAP = 10


def flip_map(blocks: DataFrame, split: bool = False) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame]:
    """Source and destination change places, and so do INS and DEL. split: also the blocks whose new
    destination is paternal, and those where it is maternal."""
    turned = F.when(F.col("feature") == "INS", "DEL").when(F.col("feature") == "DEL", "INS").otherwise(F.col("feature"))
    flipped = blocks.withColumns({"src_chr": F.col("dst_chr"), "dst_chr": F.col("src_chr"), "src_loc": F.col("dst_loc"), "dst_loc": F.col("src_loc"), "feature": turned})
    if not split:
        return flipped
    return flipped, *(flipped.filter(F.col("dst_chr").endswith(f"_{side}")) for side in ("paternal", "maternal"))


def _src(blocks: DataFrame) -> DataFrame:
    """Blocks with b_ names and the source range that a read may touch: at least one base wide."""
    b = blocks.select(*(F.col(c).alias(f"b_{c}") for c in blocks.columns))
    return b.withColumn("b_end", F.col("b_src_loc") + F.col("b_size") - 1)


def asof_block(intervals: DataFrame, blocks: DataFrame, chr: str = "chr", start: str = "start_pos", end: str = "end_pos", levels: int | None = None) -> DataFrame:
    """Half-open intervals with each block from the last one that starts at or before their start, to the
    last one that starts before their end. Blocks that share a start come together."""
    b = _src(blocks)
    starts = blocks.select("src_chr", "src_loc").distinct()
    following = scanned(in_order(starts, ["src_chr", "src_loc"]), ("src_chr",), following={"next_loc": F.col("src_loc")})
    far = following.groupBy("src_chr").agg(F.max("src_loc").alias("last"))
    following = following.join(F.broadcast(far), "src_chr").select(F.col("src_chr").alias("n_chr"), F.col("src_loc").alias("n_loc"), F.coalesce(F.col("next_loc") - 1, F.col("last") + (1 << 40) - 1).alias("b_until"))
    b = b.join(following, (b["b_src_chr"] == following["n_chr"]) & (b["b_src_loc"] == following["n_loc"])).drop("n_chr", "n_loc")
    # the last start of a chromosome reaches on without end, so it is joined apart, by chromosome
    last = b.filter(F.col("b_until") >= F.col("b_src_loc") + (1 << 39))
    inner = b.filter(F.col("b_until") < F.col("b_src_loc") + (1 << 39))
    rows = intervals.withColumn("__last", F.col(end) - 1)
    near = interval_join(rows, inner, 0, levels, (), (chr, start, "__last"), ("b_src_chr", "b_src_loc", "b_until"))
    tail = rows.join(last, (rows[chr] == last["b_src_chr"]) & (rows["__last"] >= last["b_src_loc"]))
    return near.unionByName(tail.select(near.columns)).drop("__last", "b_until", "b_end")


def _strand(direction: Column, strand: Column) -> Column:
    return F.when(direction == "+", strand).otherwise(F.when(strand == "+", "-").otherwise("+"))


def lift_intervals(intervals: DataFrame, blocks: DataFrame, min_len: int = 1, key: str = "rec_no", chr: str = "chr", start: str = "start_pos", end: str = "end_pos", strand: str | None = None, levels: int | None = None) -> DataFrame:
    """Lifted pieces of half-open intervals: key, block_no, piece_chr, piece_start, piece_end (half-open),
    piece_strand, feature, read_offset (from 1) and read_len.

    A DEL block has no width on the source and an INS block none on the destination; pieces shorter than
    min_len are left out but count for the offset. A DEL that begins before an interval has length 0.
    """
    rows = intervals.select(key, F.col(chr).alias("__chr"), (F.col(start) + 1).alias("__s"), F.col(end).alias("__e"), (F.col(strand) if strand else F.lit("+")).alias("__strand"))
    b = _src(blocks)
    pairs = interval_join(rows, b, 0, levels, (), ("__chr", "__s", "__e"), ("b_src_chr", "b_src_loc", "b_end"))
    deleted, inserted = F.col("b_feature") == "DEL", F.col("b_feature") == "INS"
    from_ = F.greatest("__s", "b_src_loc")
    to = F.least(F.col("__e"), F.col("b_src_loc") + F.when(deleted, 0).otherwise(F.col("b_size")) - 1)
    pairs = pairs.withColumn("read_len", F.greatest(to - from_ + 1, F.lit(0))).withColumn("__from", from_).withColumn("__to", to)
    left = F.col("b_dst_loc") + F.col("__from") - F.col("b_src_loc")
    right = F.when(deleted, left - 1 + F.col("b_size")).when(inserted, left - 1).otherwise(F.least(left + F.col("read_len") - 1, F.col("b_dst_loc") + F.col("b_size") - 1))
    pairs = pairs.withColumn("__size", right - left + 1)
    order = Window.partitionBy(key).orderBy("b_src_loc", "b_block_no")
    pairs = pairs.withColumn("read_offset", F.coalesce(F.sum("read_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    forward = F.col("b_direction") == "+"
    mirrored = F.col("b_dst_loc") + (F.col("b_src_loc") + F.col("b_size") - 1 - F.col("__to"))
    at = F.when(forward, F.col("b_dst_loc") + F.col("__from") - F.col("b_src_loc")).otherwise(mirrored) - 1
    return pairs.filter(F.col("__size") >= min_len).select(key, F.col("b_block_no").alias("block_no"), F.col("b_dst_chr").alias("piece_chr"), at.alias("piece_start"), (at + F.col("__size")).alias("piece_end"), _strand(F.col("b_direction"), F.col("__strand")).alias("piece_strand"), F.col("b_feature").alias("feature"), "read_offset", "read_len")


def first_indel_per_read(pieces: DataFrame, key: str = "rec_no", order: str = "b_src_loc") -> DataFrame:
    """All pieces but INS and DEL blocks after the first of each kind of a read."""
    w = Window.partitionBy(key, "b_feature").orderBy(order, "b_block_no")
    ranked = pieces.withColumn("__rank", F.row_number().over(w))
    return ranked.filter(~F.col("b_feature").isin("INS", "DEL") | (F.col("__rank") == 1)).drop("__rank")


def lift_loci(reads: DataFrame, blocks: DataFrame, key: str = "rec_no", chr: str = "chr", start: str = "start_pos", end: str = "end_pos", direction: str | None = None, min_overlap: int = MIN_READ_OVERLAP, levels: int | None = None) -> DataFrame:
    """Loci of reads (half-open, 1-based start): key, block_no, loc_chr, loc, feature, direction. The first
    INS and the first DEL block give a locus each; others must overlap by min_overlap bases. A locus is
    where the whole read would start, which may lie before the block."""
    pairs = first_indel_per_read(asof_block(reads, blocks, chr, start, end, levels), key)
    s, e = F.col(start), F.col(end)
    indel = F.col("b_feature").isin("INS", "DEL")
    overlap = F.least(e - 1, F.col("b_src_loc") + F.col("b_size") - 1) - F.greatest(s, F.col("b_src_loc")) + 1
    forward = F.col("b_direction") == "+"
    there = F.when(forward, F.col("b_dst_loc") + s - F.col("b_src_loc")).otherwise(F.col("b_dst_loc") + F.col("b_size") - (e - (F.col("b_src_loc") + 1)))
    own = F.col(direction) if direction else F.lit("+")
    return pairs.filter(indel | (overlap >= min_overlap)).select(key, F.col("b_block_no").alias("block_no"), F.col("b_dst_chr").alias("loc_chr"), F.when(indel, F.col("b_dst_loc")).otherwise(there).alias("loc"), F.col("b_feature").alias("feature"), F.when(indel, own).otherwise(_strand(F.col("b_direction"), own)).alias("direction"))


def lift_merge(pieces: DataFrame, key: str = "rec_no") -> DataFrame:
    """Pieces of each key, merged where they touch; the strand is lost."""
    closed = pieces.select(key, F.col("piece_chr").alias("chr"), (F.col("piece_start") + 1).alias("start"), F.col("piece_end").alias("end"))
    merged = merge_intervals(closed, by=(key,))
    return merged.select(key, F.col("chr").alias("piece_chr"), (F.col("start") - 1).alias("piece_start"), F.col("end").alias("piece_end"))


def assign_coordinates(blocks: DataFrame, by: str = "src_chr", order: str = "block_no") -> DataFrame:
    """src_loc and dst_loc of ordered blocks: DEL takes no source, INS no destination."""
    but = lambda kind: F.when(F.col("feature") == kind, 0).otherwise(F.col("size"))
    rows = scanned(in_order(blocks, [by, order]), (by,), sums={"__src": but("DEL"), "__dst": but("INS")})
    return rows.withColumns({"src_loc": F.col("__src") + 1, "dst_loc": F.col("__dst") + 1}).drop("__src", "__dst")


_REGION = r"^(.*)_(\d+)_(\d+)$"


def lift_region_variants(variants: DataFrame) -> DataFrame:
    """Contigs named chr_start_end become chr, and pos, END, POS2 and END2 (in info) move by start - 1."""
    named = F.col("chr").rlike(_REGION)
    offset = F.when(named, F.regexp_extract("chr", _REGION, 2).cast("long") - 1).otherwise(0)
    moved = variants.withColumn("__o", offset).withColumn("pos", F.col("pos") + F.col("__o"))
    if "info" in variants.columns:
        shift = lambda k, v: F.when(k.isin("END", "POS2", "END2"), F.array_join(F.transform(F.split(v, ","), lambda x: (x.cast("long") + F.col("__o")).cast("string")), ",")).otherwise(v)
        moved = moved.withColumn("info", F.transform_values("info", shift))
    return moved.withColumn("chr", F.when(named, F.regexp_extract("chr", _REGION, 1)).otherwise(F.col("chr"))).drop("__o")


def lift_region_map(blocks: DataFrame) -> DataFrame:
    """The same on the destination side of a block map; other contigs are dropped."""
    named = blocks.filter(F.col("dst_chr").rlike(_REGION))
    return named.withColumns({"dst_chr": F.regexp_extract("dst_chr", _REGION, 1), "dst_loc": F.col("dst_loc") + F.regexp_extract("dst_chr", _REGION, 2).cast("long") - 1})


def mappable(feature: Column) -> Column:
    return feature.isin(*C.MAPPABLE_BLOCKS)
