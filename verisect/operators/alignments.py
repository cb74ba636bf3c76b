"""Outcomes of read alignments against their true loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import in_regions

UNMAPPED_MAPQ = 255


def primary_only(flags: Column) -> Column:
    """Neither secondary nor supplementary."""
    return flags.bitwiseAND(0x100 | 0x800) == 0


def is_unmapped(flags: Column) -> Column:
    return flags.bitwiseAND(0x4) != 0


def truth_loci_join(alignments: DataFrame, truth: DataFrame) -> DataFrame:
    """Alignments with their true loci (read_name, mate, loci: array<struct<chr,loc,feature>>)."""
    return alignments.join(truth, ["read_name", "mate"], "left")


def is_close_alignment(loci: Column, chr: Column, pos: Column, wiggle: int) -> Column:
    """Whether some mappable true locus lies within wiggle."""
    near = F.exists(loci, lambda x: x["feature"].isin(*C.MAPPABLE_BLOCKS) & C.is_close(x["chr"], x["loc"], chr, pos, wiggle))
    return F.coalesce(near, F.lit(False))


def truly_unmapped(loci: Column) -> Column:
    """No true locus is mappable; no locus at all counts too."""
    return ~F.coalesce(F.exists(loci, lambda x: x["feature"].isin(*C.MAPPABLE_BLOCKS)), F.lit(False))


def classify_alignments(df: DataFrame, wiggle: int = 20, mapq: int = 10, identity: float = 1.0) -> DataFrame:
    """Adds status (TP, FP, TN, FN), tum (should be unmapped but is mapped) and mapq 255 for unmapped
    reads; df: loci, chr, pos, mapq, flags, identity."""
    unmapped, absent = is_unmapped(F.col("flags")), truly_unmapped(F.col("loci"))
    close = is_close_alignment(F.col("loci"), F.col("chr"), F.col("pos"), wiggle)
    doubtful = (F.col("identity") <= identity) & (F.col("mapq") > mapq)
    status = F.when(unmapped, F.when(absent, "TN").otherwise("FN")).when(absent, "TP").when(~close & doubtful, "FP").otherwise("TP")
    return df.withColumns({"status": status, "tum": ~unmapped & absent & doubtful, "mapq": F.when(unmapped, UNMAPPED_MAPQ).otherwise(F.col("mapq"))})


def events_of(loci: Column) -> Column:
    """Events that a read carries: All, True_Unmapped if no locus is mappable, and its loci's features."""
    features = F.coalesce(F.array_distinct(F.transform(loci, lambda x: x["feature"])), F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("All")), F.when(truly_unmapped(loci), F.array(F.lit("True_Unmapped"))).otherwise(F.array().cast("array<string>")), features)


def in_true_regions(df: DataFrame, regions: DataFrame, read_len: str = "read_len") -> DataFrame:
    """Reads (unique by read_name and mate) with a true locus that, a read's length wide, lies in a region;
    reads without loci are left out."""
    loci = df.select("read_name", "mate", read_len, F.posexplode("loci").alias("__n", "l")).select("read_name", "mate", F.col("l.chr").alias("chr"), F.col("l.loc").alias("start"), (F.col("l.loc") + F.col(read_len) - 1).alias("end"), "__n")
    hit = in_regions(loci, regions, ("read_name", "mate", "__n")).select("read_name", "mate").distinct()
    return df.join(hit, ["read_name", "mate"], "left_semi")


def write_fp_alignments(df: DataFrame, path: str) -> None:
    """False positives by every event they carry (All among them), and reads that should be unmapped."""
    fp = df.filter("status = 'FP'").withColumn("event", F.explode("features"))
    tum = df.filter("tum").withColumn("event", F.lit("should_be_unmapped"))
    fp.unionByName(tum).write.partitionBy("event").parquet(path)
