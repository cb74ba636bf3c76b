"""Combining, ordering, sampling and numbering of variant sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.scan import in_order, scanned
from verisect.operators.storage import numbered, placed, stored

ALLELE = ("chr", "pos", "ref", "alt")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; file_no is the frame's number."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("file_no", F.lit(i)) for i, f in enumerate(frames)])


def combine(frames: list[DataFrame], mode: str = "all", key: tuple[str, ...] = ALLELE, order: tuple[str, ...] = ("file_no", "rec_no")) -> DataFrame:
    """mode all: every row; first: of equal keys the first in order; unique: only keys that occur once."""
    rows = union_all(*frames)
    if mode == "all":
        return rows
    if mode == "first":
        return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rank = 1").drop("__rank")
    if mode == "unique":
        return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*key))).filter("__n = 1").drop("__n")
    raise ValueError(f"unknown mode {mode!r}")


def union_first(*frames: DataFrame, key: tuple[str, ...] = ALLELE) -> DataFrame:
    """Distinct by key; the first frame wins."""
    return combine(list(frames), "first", key)


def only_once(*frames: DataFrame, key: tuple[str, ...] = ALLELE) -> DataFrame:
    """Rows whose key occurs once over all frames; repeats within a frame count too."""
    return combine(list(frames), "unique", key)


def concat_files(*frames: DataFrame) -> DataFrame:
    """Files one after the other: rec_no (below 2^40 in each, else the query fails) goes on over the frames, in
    their order."""
    own = F.col("rec_no").cast("long")
    fits = F.when(own.between(0, (1 << 40) - 1), own).otherwise(F.raise_error(F.concat(F.lit("no record number of a file: "), own.cast("string"))).cast("long"))
    return union_all(*frames).withColumn("rec_no", F.shiftleft(F.col("file_no").cast("long"), 40) + fits)


def chr_in(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("chr").isin(*names))


def on_chr(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("chr") == name)


def len_between(df: DataFrame, lo: int, hi: int, least: str = "min_len", most: str = "max_len") -> DataFrame:
    return df.filter((F.col(most) <= hi) & (F.col(least) >= lo))


def except_keys(a: DataFrame, b: DataFrame, key: tuple[str, ...] = ALLELE) -> DataFrame:
    """Rows of a whose key isn't in b."""
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def merge_results(tp: DataFrame, fp: DataFrame, fn: DataFrame, rescued_truth: DataFrame, rescued_calls: DataFrame, key: tuple[str, ...] = ALLELE) -> dict[str, DataFrame]:
    """TP with rescued truth added once; T = TP and FN; FN = T without TP; FP without rescued calls."""
    new_tp = combine([tp, rescued_truth], "first", key)
    known = combine([tp, fn], "first", key)
    return {"TP": new_tp, "T": known, "FN": except_keys(known, new_tp, key), "FP": except_keys(fp, rescued_calls, key)}


def order_vcf(df: DataFrame) -> DataFrame:
    """Natural chromosome order, then position, REF and ALT."""
    return df.orderBy(C.natural_key(F.col("chr")), "pos", "ref", "alt")


def order_lifted(df: DataFrame) -> DataFrame:
    """Order after a lift from regions, without repeats."""
    return df.dropDuplicates(list(ALLELE)).orderBy("chr", "pos", "ref", "alt")


def order_variants(df: DataFrame) -> DataFrame:
    """By chromosome and the start with its padding base."""
    return df.orderBy("chr", F.col("pos") - F.length("ref_deleted"), "file_no", "rec_no")


def order_loci(df: DataFrame) -> DataFrame:
    return df.orderBy("chr", "start", "end")


def file_order(df: DataFrame) -> DataFrame:
    return df.orderBy("file_no", "rec_no")


def assert_sorted(df: DataFrame, order: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """df, if positions never fall within a chromosome; else the plan raises when it runs."""
    rows = scanned(in_order(df, ["chr", *order]), ("chr",), previous={"__before": F.col("pos")})
    falls = F.col("__before") > F.col("pos")
    checked = F.when(falls, F.raise_error(F.concat(F.lit("not sorted by position at "), F.col("chr"), F.lit(":"), F.col("pos").cast("string"))).cast("long")).otherwise(F.col("pos"))
    return rows.withColumn("pos", checked).drop("__before")


def sample_exact(df: DataFrame, sizes: dict[str, int], key: Column | None = None, kind: str = "overall_type", seed: int = 0, tie: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """Exactly the number asked for of each kind (or all, if fewer), without replacement. The order is by
    key, a hash of seed and the tie columns unless given; ranks are cut before the shuffle."""
    by = key if key is not None else F.xxhash64(F.lit(seed), *tie)
    wanted = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    ranked = df.withColumn("__by", by).withColumn("__rank", F.row_number().over(Window.partitionBy(kind).orderBy("__by", *tie)))
    most = max(sizes.values(), default=0)
    return ranked.filter((F.col("__rank") <= most) & (F.col("__rank") <= F.coalesce(wanted[F.col(kind)], F.lit(0)))).drop("__by", "__rank")


def number_rows(df: DataFrame, order: tuple[str, ...], name: str = "number", start: int = 0) -> DataFrame:
    """Running numbers over the whole frame without a single-task window: sorted rows are written once with
    their places, and each partition starts where those before it end."""
    return numbered(stored(placed(df.orderBy(*order))), name, start)


def tag_somatic(df: DataFrame, tag: str = "COSMIC", name: str = "SOMATIC") -> DataFrame:
    """Records whose id lacks the tag get a running number with name, after their own id if there is one."""
    lacks = ~F.col("id").contains(tag)
    rows = scanned(in_order(df, ["file_no", "rec_no"]), ("file_no",), sums={"__number": lacks.cast("int")})
    new = F.concat(F.lit(name), F.lit("_"), F.col("__number").cast("string"))
    tagged = rows.withColumn("id", F.when(lacks, F.when(F.col("id").isin("", "."), new).otherwise(F.concat(F.col("id"), F.lit(","), new))).otherwise(F.col("id")))
    return tagged.drop("__number")


def split_somatic(df: DataFrame, tag: str = "SOMATIC") -> tuple[DataFrame, DataFrame]:
    """(somatic, normal) by the id."""
    has = F.coalesce(F.col("id").contains(tag), F.lit(False))
    return df.filter(has), df.filter(~has)


def pair_by_traid(df: DataFrame) -> DataFrame:
    """Records of one TRAID, two by two in order: (traid, pair, members); what is left alone is dropped."""
    place = F.row_number().over(Window.partitionBy("traid").orderBy("rec_no")) - 1
    numbered = df.filter(F.col("traid").isNotNull()).withColumn("pair", F.floor(place / 2))
    pairs = numbered.groupBy("traid", "pair").agg(F.array_sort(F.collect_list("rec_no")).alias("members"))
    return pairs.filter(F.size("members") == 2)
