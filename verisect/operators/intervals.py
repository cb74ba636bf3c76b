"""Range joins on genomic intervals, and what is built on them.

Spark has no range join of its own, so intervals are dealt to bins of a chromosome and joined by (bin,
chromosome) with the range test as residual. An interval belongs to the bins it touches at its own level
(bin width by its length) and at all coarser levels in use; two intervals meet at the coarser of their
levels, and only in the first bin that both touch, so a pair comes out once without a distinct. No
interval touches more than a few bins, however long. Hot bins are split by Spark's skew handling.

Frames have the columns chr, start, end (closed, 1-based) unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.scan import in_order, scanned

#: Bits of the bin width at each level: 2 kb, 128 kb, 8 Mb, and a whole chromosome.
LEVELS = (11, 17, 23, 40)


def _level(size: Column) -> Column:
    level = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        level = F.when(size <= (1 << LEVELS[i]), i).otherwise(level)
    return level


def _binned(df: DataFrame, start: Column, end: Column, levels: int, tag: str) -> DataFrame:
    """Adds tag_level (own), tag_at (level of the copy), tag_bin, one row per bin."""
    # outer: for the inner kind Spark derives a filter that repeats the expression; there is always a bin
    if levels == 1:
        touched = F.sequence(F.shiftright(F.least(start, end), LEVELS[0]), F.shiftright(F.greatest(start, end), LEVELS[0]))
        return df.withColumn(f"{tag}_bin", F.explode_outer(touched)).withColumns({f"{tag}_level": F.lit(0), f"{tag}_at": F.lit(0)})
    own = F.least(_level(end - start + 1), F.lit(levels - 1))

    def cells(level: int) -> Column:
        touched = F.sequence(F.shiftright(F.least(start, end), LEVELS[level]), F.shiftright(F.greatest(end, start), LEVELS[level]))
        return F.transform(touched, lambda b: F.struct(F.lit(level).alias("at"), b.alias("bin")))

    none = F.array().cast("array<struct<at:int,bin:bigint>>")
    every = F.concat(*[F.when(own <= i, cells(i)).otherwise(none) for i in range(levels)])
    out = df.withColumn(f"{tag}_level", own).withColumn(f"{tag}_cell", F.explode_outer(every))
    return out.withColumns({f"{tag}_at": F.col(f"{tag}_cell.at"), f"{tag}_bin": F.col(f"{tag}_cell.bin")}).drop(f"{tag}_cell")


def levels_for(*frames: tuple[DataFrame, str, str]) -> int:
    """How many levels the longest interval of these frames needs (one small aggregate)."""
    longest = max((df.agg(F.max(F.col(e) - F.col(s) + 1)).first()[0] or 1) for df, s, e in frames)
    return next(i + 1 for i, bits in enumerate(LEVELS) if longest <= 1 << bits or i == len(LEVELS) - 1)


def interval_join(left: DataFrame, right: DataFrame, widen: int = 0, levels: int | None = None, on: tuple[tuple[str, str], ...] = (), left_cols: tuple[str, str, str] = ("chr", "start", "end"), right_cols: tuple[str, str, str] = ("r_chr", "r_start", "r_end")) -> DataFrame:
    """All pairs on one chromosome that share a base, or lie within widen of it; the frames' columns must
    have different names. on: further pairs of columns that must be equal. levels: how many bin levels to
    use; measured if None."""
    (lc, ls, le), (rc, rs, re_) = left_cols, right_cols
    levels = levels or levels_for((left, ls, le), (right, rs, re_))
    a = _binned(left, F.col(ls) - widen, F.col(le) + widen, levels, "l")
    b = _binned(right, F.col(rs), F.col(re_), levels, "r")
    same = (a[lc] == b[rc]) & (a["l_bin"] == b["r_bin"])
    for x, y in on:
        same = same & (a[x] == b[y])
    if levels > 1:
        same = same & (a["l_at"] == b["r_at"]) & (F.greatest("l_level", "r_level") == F.col("l_at"))
    first = F.greatest(F.least(F.col(ls) - widen, F.col(le) + widen), F.least(F.col(rs), F.col(re_)))
    first_bin = F.shiftright(first, LEVELS[0])
    for level in range(1, levels):
        first_bin = F.when(F.col("l_at") == level, F.shiftright(first, LEVELS[level])).otherwise(first_bin)
    meet = (F.col("l_bin") == first_bin) & (F.col(ls) - widen <= F.col(re_)) & (F.col(le) + widen >= F.col(rs))
    return a.join(b, same & meet).drop("l_level", "l_at", "l_bin", "r_level", "r_at", "r_bin")


def overlap_join(left: DataFrame, right: DataFrame, ratio: float, wiggle: int, on=(), levels: int | None = None, left_cols=("chr", "start", "end"), right_cols=("r_chr", "r_start", "r_end")) -> DataFrame:
    """Pairs with reciprocal overlap of at least ratio after a shift by at most wiggle."""
    pairs = interval_join(left, right, wiggle, levels, on, left_cols, right_cols)
    return pairs.filter(C.overlaps(F.col(left_cols[1]), F.col(left_cols[2]), F.col(right_cols[1]), F.col(right_cols[2]), ratio, wiggle))


def breakend_join(left: DataFrame, right: DataFrame, wiggle: int, levels: int | None = None) -> DataFrame:
    """Breakends (chr, pos, mate_chr, mate_pos, left, forward; the right side's with r_) whose places and
    mates lie within wiggle, with equal orientation."""
    a = left.withColumns({"__s": F.col("pos"), "__e": F.col("pos")})
    b = right.withColumns({"__rs": F.col("r_pos"), "__re": F.col("r_pos")})
    pairs = interval_join(a, b, wiggle, levels or 1, (("mate_chr", "r_mate_chr"), ("left", "r_left"), ("forward", "r_forward")), ("chr", "__s", "__e"), ("r_chr", "__rs", "__re"))
    return pairs.filter(F.abs(F.col("mate_pos") - F.col("r_mate_pos")) <= wiggle).drop("__s", "__e", "__rs", "__re")


def merge_intervals(df: DataFrame, cols: tuple[str, str, str] = ("chr", "start", "end"), gap: int = 1, by: tuple[str, ...] = (), chunk_bits: int = 22) -> DataFrame:
    """Islands (by, chr, start, end) of intervals that overlap or lie less than gap apart.

    First within stretches of a chromosome, then over the islands that are left, so that no task sorts a
    whole chromosome of input rows.
    """
    c, s, e = cols

    def islands(rows: DataFrame, keys: list) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(s, e)
        reach = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(s) > reach + gap), 1).otherwise(0))
        marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "__island").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("__island")

    keys = [*by, c]
    near = islands(df.select(*keys, s, e).withColumn("__chunk", F.shiftright(s, chunk_bits)), [*keys, "__chunk"])
    return islands(near.drop("__chunk"), keys)


def sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stretches (chr, start, end, in_a, in_b) between the ends of two sets of intervals (chr, start, end), which
    may overlap; stretches outside both are left out. Ends are put in order and the open intervals are counted
    along, so no interval meets all those that lie in it."""
    ends = lambda df, k: df.filter("end >= start").select("chr", F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("chr", "x.at", *(F.when(F.lit(k == i), F.col("x.d")).otherwise(0).alias(n) for i, n in enumerate(("a", "b"))))
    steps = ends(a, 0).unionByName(ends(b, 1)).groupBy("chr", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = scanned(in_order(steps, ["chr", "at"]), ("chr",), sums={"a_before": F.col("a"), "b_before": F.col("b")}, following={"next": F.col("at")})
    open_ = rows.select("chr", F.col("at").alias("start"), (F.col("next") - 1).alias("end"), (F.col("a") + F.col("a_before") > 0).alias("in_a"), (F.col("b") + F.col("b_before") > 0).alias("in_b"))
    return open_.filter("end is not null and (in_a or in_b)")


def intersect_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chr, start, end) of what both sets cover, cut at the ends of their intervals."""
    return sweep(a, b).filter("in_a and in_b").select("chr", "start", "end")


def subtract_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chr, start, end) of what a covers and b doesn't, cut at the ends of their intervals."""
    return sweep(a, b).filter("in_a and not in_b").select("chr", "start", "end")


def in_regions(df: DataFrame, regions: DataFrame, key: tuple[str, ...], cols: tuple[str, str, str] = ("chr", "start", "end"), levels: int | None = None) -> DataFrame:
    """Rows of df (unique by key) that share a base with any region (chr, start, end)."""
    merged = merge_intervals(regions).select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hits = interval_join(df.select(*{*key, *cols}), merged, levels=levels, left_cols=cols).select(*key).distinct()
    return df.join(hits, list(key), "left_semi")


def point_flags(df: DataFrame, regions: DataFrame, points: dict[str, str], chr: str = "chr", bits: int = 14) -> DataFrame:
    """Adds a boolean column for each point column: whether it lies in a region (chr, start, end).

    Merged regions are cut at bin borders, so a point meets at most one piece and no row is doubled.
    """
    pieces = merge_intervals(regions).withColumn("__bin", F.explode(F.sequence(F.shiftright("start", bits), F.shiftright("end", bits))))
    out = df
    for name, point in points.items():
        p = pieces.select(F.col("chr").alias("__c"), F.col("__bin").alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        hit = (out[chr] == p["__c"]) & (F.shiftright(out[point], bits) == p["__b"]) & out[point].between(p["__s"], p["__e"])
        out = out.join(p, hit, "left")
        # two merged regions may touch one bin, but only one holds the point
        out = out.withColumn(name, F.col("__c").isNotNull()).drop("__c", "__b", "__s", "__e")
    return out


def endpoints_in_regions(df: DataFrame, regions: DataFrame, either: bool = False, cols: tuple[str, str, str] = ("chr", "start", "end")) -> DataFrame:
    """Rows with both ends (or either end) in some region."""
    c, s, e = cols
    flagged = point_flags(df, regions, {"__in_start": s, "__in_end": e}, c)
    test = (F.col("__in_start") | F.col("__in_end")) if either else (F.col("__in_start") & F.col("__in_end"))
    return flagged.filter(test).drop("__in_start", "__in_end")


def nearest_join(left: DataFrame, right: DataFrame, within: int = 100, key: tuple[str, ...] = ("rec_no",), tie: str = "r_rec_no") -> DataFrame:
    """For each left row (chr, pos; unique by key) the right row (r_chr, r_pos) at the least distance below
    within; ties go to the least tie column. Rows without one are left out."""
    a = left.withColumns({"__s": F.col("pos"), "__e": F.col("pos")})
    b = right.withColumns({"__rs": F.col("r_pos"), "__re": F.col("r_pos")})
    pairs = interval_join(a, b, within - 1, 1, (), ("chr", "__s", "__e"), ("r_chr", "__rs", "__re")).drop("__s", "__e", "__rs", "__re")
    pairs = pairs.withColumn("distance", F.abs(F.col("pos") - F.col("r_pos")))
    rest = [x for x in pairs.columns if x not in key]
    best = pairs.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("distance", tie)).alias("b"))
    return best.select(*key, *(F.col(f"b.{x}").alias(x) for x in rest))


def allele_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("chr", "pos", "ref", "alt"), tie: str = "r_rec_no") -> DataFrame:
    """Left rows with the first right row (r_ columns) of equal keys."""
    value = [x for x in right.columns if x not in {f"r_{k}" for k in keys}]
    first = right.groupBy(*[f"r_{k}" for k in keys]).agg(F.min_by(F.struct(*value), F.col(tie)).alias("b"))
    hit = None
    for k in keys:
        same = left[k] == first[f"r_{k}"]
        hit = same if hit is None else hit & same
    return left.join(first, hit).select(*left.columns, *(F.col(f"b.{x}").alias(x) for x in value))


def restrict_to_regions(df: DataFrame, regions: DataFrame, flank: int = 0, short_names: bool = False, levels: int | None = None) -> DataFrame:
    """Rows (chr, start, end, ...) wholly inside a region with a margin of flank at its start; positions
    are counted from the region and the contig is named chr_start_end (or the region's number in order)."""
    r = regions.select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    if short_names:
        ordered = scanned(in_order(r, ["r_chr", "r_start", "r_end"]), sums={"__n": F.lit(1)})
        r = ordered.withColumn("r_name", (F.col("__n") + 1).cast("string")).drop("__n")
    else:
        r = r.withColumn("r_name", F.concat_ws("_", "r_chr", F.col("r_start").cast("string"), F.col("r_end").cast("string")))
    pairs = interval_join(df, r, levels=levels).filter((F.col("start") >= F.col("r_start") + flank) & (F.col("end") <= F.col("r_end") - flank))
    moved = {"chr": F.col("r_name"), "end": F.col("end") - F.col("r_start") + 1, "start": F.col("start") - F.col("r_start") + 1}
    return pairs.withColumns(moved).select(*df.columns)


def region_bases(regions: DataFrame, chunks: DataFrame, levels: int | None = None) -> DataFrame:
    """(chr, start, end, bases) of regions, from contig chunks (contig, start, bases); chunks are put
    together per region, so regions should be of bounded length."""
    c = chunks.select(F.col("contig").alias("r_chr"), F.col("start").alias("r_start"), (F.col("start") + F.length("bases") - 1).alias("r_end"), F.col("bases").alias("r_bases"))
    pairs = interval_join(regions.select("chr", "start", "end"), c, levels=levels)
    skip = F.greatest(F.col("start") - F.col("r_start"), F.lit(0))
    part = F.substr("r_bases", (skip + 1).cast("int"), (F.least("end", "r_end") - F.greatest("start", "r_start") + 1).cast("int"))
    parts = pairs.groupBy("chr", "start", "end").agg(F.array_sort(F.collect_list(F.struct("r_start", part.alias("bases")))).alias("p"))
    return parts.select("chr", "start", "end", F.array_join(F.transform("p", lambda x: x["bases"]), "").alias("bases"))


def add_anchor_base(variants: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Adds ``anchor``: the reference base before pos, for variants that lost their padding base (one of
    REF and ALT is empty and ref_deleted is empty); from chunks of equal size that start at 1."""
    c = chunks.select(F.col("contig").alias("__contig"), F.floor((F.col("start") - 1) / chunk_size).alias("__no"), F.col("start").alias("__from"), F.col("bases").alias("__bases"))
    before = F.col("pos") - 1
    joined = variants.join(c, (variants["chr"] == c["__contig"]) & (F.floor((before - 1) / chunk_size) == c["__no"]), "left")
    return joined.withColumn("anchor", F.substr("__bases", (before - F.col("__from") + 1).cast("int"), F.lit(1))).drop("__contig", "__no", "__from", "__bases")
