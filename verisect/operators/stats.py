"""Confusion counts, size bins, ladders over mapping quality, and summaries.

Input of the counts: one row per counted item with ``outcome`` (TP, FP or FN), ``overall_type`` and
``len``. T (all known) is TP and FN together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import intersect_intervals
from verisect.operators.scan import in_order, scanned


def _counts() -> list[Column]:
    is_ = lambda *names: F.col("outcome").isin(*names)
    return [F.count_if(is_("TP")).alias("tp"), F.count_if(is_("FP")).alias("fp"), F.count_if(is_("TP", "FN")).alias("t")]


def confusion_counts(outcomes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return outcomes.groupBy(*by).agg(*_counts())


def confusion_by_type(outcomes: DataFrame) -> DataFrame:
    """tp, fp and t for each overall type, and for all types together (overall_type ``All``)."""
    total = outcomes.rollup("overall_type").agg(F.grouping("overall_type").alias("__all"), *_counts())
    return total.select(F.when(F.col("__all") == 1, "All").otherwise(F.col("overall_type")).alias("overall_type"), "tp", "fp", "t")


def confusion_by_bin(outcomes: DataFrame, breaks: tuple[int, ...] = C.SIZE_BREAKS, sv_length: int | None = None) -> DataFrame:
    """tp, fp and t for each overall type and size bin, empty bins included; sv_length: only items at
    least that long."""
    rows = outcomes if sv_length is None else outcomes.filter(F.col("len") >= sv_length)
    counted = rows.groupBy("overall_type", C.size_bin(F.col("len"), breaks).alias("bin")).agg(*_counts())
    grid = outcomes.select("overall_type").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(breaks)))))
    full = grid.join(counted, ["overall_type", "bin"], "left").fillna(0, ["tp", "fp", "t"])
    return full.withColumn("bin_range", C.bin_label(F.col("bin"), breaks))


def per_base(outcomes: DataFrame) -> DataFrame:
    """Sums of lengths by type: TP and FP by length, T by length but 0 for insertions."""
    size = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), F.col("len")).otherwise(0))
    known = F.sum(F.when(F.col("outcome").isin("TP", "FN") & (F.col("overall_type") != "Insertion"), F.col("len")).otherwise(0))
    return outcomes.groupBy("overall_type").agg(size("TP").alias("tp_bases"), size("FP").alias("fp_bases"), known.alias("t_bases"))


def true_negatives(bases: DataFrame, genome_bases: int | Column | DataFrame) -> DataFrame:
    """Adds tn_bases: bases that are neither known nor called; genome_bases: a number, or the row of non_n_bases."""
    if isinstance(genome_bases, DataFrame):
        genome_bases = genome_bases.first()["non_n"]
    genome = F.lit(genome_bases) if isinstance(genome_bases, int) else genome_bases
    return bases.withColumn("tn_bases", genome - F.col("t_bases") - F.col("fp_bases"))


def base_runs(chunks: DataFrame) -> DataFrame:
    """(chr, start, end) of the longest stretches without N within contig chunks (contig, start, bases)."""
    runs = F.regexp_extract_all("bases", F.lit("([Nn]+|[^Nn]+)"), F.lit(1))
    each = chunks.select("contig", F.col("start").alias("chunk"), F.posexplode(runs).alias("i", "run")).withColumn("n", F.length("run"))
    within = Window.partitionBy("contig", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # the runs of a chunk
    at = F.col("chunk") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return each.withColumn("start", at.cast("long")).filter(~F.col("run").rlike("^[Nn]")).select(F.col("contig").alias("chr"), "start", (F.col("start") + F.col("n") - 1).alias("end"))


def non_n_bases(chunks: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row: the bases other than N of contig chunks; with regions (chr, start, end; they may overlap) only
    those that lie in some region."""
    if regions is None:
        return chunks.agg(F.coalesce(F.sum(C.non_n(F.col("bases"))), F.lit(0)).cast("long").alias("non_n"))
    both = intersect_intervals(base_runs(chunks), regions)
    return both.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("non_n"))


def with_metrics(counts: DataFrame, tp: str = "tp", fp: str = "fp", t: str = "t", tn: Column | None = None, places: int | None = None) -> DataFrame:
    """Adds tpr, fdr, ppv, spc and f1; null where undefined."""
    found = C.metrics(F.col(tp), F.col(fp), F.lit(0) if tn is None else tn, F.col(t))
    return counts.withColumns({k: v if places is None else F.round(v, places) for k, v in found.items()})


def ladder(counts: DataFrame, by: tuple[str, ...], top: int = 255) -> DataFrame:
    """Counts (by, mapq, tp, fp, tn, fn) per cut-off 0..top: what has a mapq of at least the cut-off.

    Counts are summed by mapq first, so the window runs over at most top + 1 rows for each key.
    """
    names = ("tp", "fp", "tn", "fn")
    per = counts.groupBy(*by, "mapq").agg(*(F.sum(n).alias(n) for n in names))
    grid = (per.select(*by).distinct() if by else per.select(F.lit(1).alias("__one")).distinct()).withColumn("mapq", F.explode(F.sequence(F.lit(0), F.lit(top)))).drop("__one")
    full = grid.join(per, [*by, "mapq"], "left").fillna(0, list(names))
    down = Window.partitionBy(*by).orderBy(F.desc("mapq")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, F.col("mapq").alias("cutoff"), *(F.sum(n).over(down).alias(n) for n in names))


def confusion_by_mapq(alignments: DataFrame, top: int = 255) -> DataFrame:
    """Cumulative tp, fp, tn and fn per mapq cut-off; alignments: (status, mapq)."""
    return ladder(_status_counts(alignments, ()), (), top)


def confusion_by_event(alignments: DataFrame, events: str = "features", top: int = 255) -> DataFrame:
    """The ladder for each event that an alignment carries (an array), and t: all that carry it."""
    each = alignments.withColumn("event", F.explode(F.array_distinct(F.col(events))))
    known = each.groupBy("event").agg(F.count("*").alias("t"))
    return ladder(_status_counts(each, ("event",)), ("event",), top).join(known, "event")


def _status_counts(alignments: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return alignments.groupBy(*by, "mapq").agg(*(F.count_if(F.col("status") == s.upper()).alias(s) for s in ("tp", "fp", "tn", "fn")))


def variant_stats(variants: DataFrame, breaks: tuple[int, ...] = C.SIZE_BREAKS, sv_length: int = C.SV_LENGTH) -> DataFrame:
    """Variants (gt_p, gt_m, overall_type, len) per haplotype and overall, type and bin: n, and n_sv of
    those at least sv_length long."""
    haplotypes = F.array_compact(F.array(F.when(F.col("gt_p") > 0, "paternal"), F.when(F.col("gt_m") > 0, "maternal"), F.when((F.col("gt_p") > 0) | (F.col("gt_m") > 0), "overall")))
    each = variants.withColumn("haplotype", F.explode(haplotypes))
    return each.groupBy("haplotype", "overall_type", C.size_bin(F.col("len"), breaks).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("len") >= sv_length).alias("n_sv"))


def haplotype_rows(variants: DataFrame) -> DataFrame:
    """A row for each haplotype that carries a variant, with the type and length of its own allele, and one for
    both together: rec_no, chr, haplotype (paternal, maternal, overall), overall_type, len, start, end. variants:
    canonical rows; missing alleles are filled in."""
    eff = C.effective_alleles(F.col("gt_p"), F.col("gt_m"), F.size("alts"), F.col("chr"))

    def own(name: str, g: Column) -> Column:
        alt = F.try_element_at("alts", F.when(g > 0, g).otherwise(1))
        kind, size = C.overall_type(F.array(alt["allele_type"])), F.greatest("ref_len", alt["alt_len"])
        return F.when(g > 0, F.struct(F.lit(name).alias("haplotype"), kind.alias("overall_type"), size.cast("int").alias("len")))

    both = F.struct(F.lit("overall").alias("haplotype"), F.col("overall_type"), F.col("max_len").cast("int").alias("len"))
    some = F.when((F.col("e.p") > 0) | (F.col("e.m") > 0), both)
    each = variants.withColumn("e", eff).withColumn("x", F.explode(F.array_compact(F.array(own("paternal", F.col("e.p")), own("maternal", F.col("e.m")), some))))
    return each.select("rec_no", "chr", "x.*", F.col("pos").alias("start"), (F.col("pos") + F.greatest("ref_len", F.lit(1)) - 1).alias("end"))


def haplotype_stats(rows: DataFrame, breaks: tuple[int, ...] = C.SIZE_BREAKS, sv_length: int = C.SV_LENGTH) -> DataFrame:
    """Rows of haplotype_rows per haplotype, type and bin: n, and n_sv of those at least sv_length long."""
    return rows.groupBy("haplotype", "overall_type", C.size_bin(F.col("len"), breaks).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("len") >= sv_length).alias("n_sv"))


def _cell(tp: Column, fp: Column, t: Column, tn: Column | None = None, lower: Column | int = -1, upper: Column | int = -1) -> Column:
    """A report's cell: counts, their rates (NaN for 0 / 0, as text in JSON), and its bin's limits (-1: none)."""
    long = lambda c: (F.lit(c) if isinstance(c, int) else F.coalesce(c, F.lit(0))).cast("long")
    tp, fp, t, tn = long(tp), long(fp), long(t), long(0 if tn is None else tn)

    def over(a: Column, b: Column) -> Column:
        return F.when(b != 0, a.cast("double") / F.when(b != 0, b)).when(a > 0, float("inf")).otherwise(float("nan"))

    tpr, fdr = over(tp, t), over(fp, tp + fp)
    rates = {"tpr": tpr, "fdr": fdr, "ppv": over(tp, tp + fp), "spc": over(tn, tn + fp), "f1": over(F.lit(2.0) * (F.lit(1.0) - fdr) * tpr, F.lit(1.0) - fdr + tpr)}
    fn = F.lit(0).cast("long")  # what is missed is counted in T alone
    counts = {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "t": t, "_TP": tp, "_FP": fp, "_TN": tn, "_FN": fn, "_T": t}
    limits = {k: (F.lit(v) if isinstance(v, int) else v).cast("int") for k, v in (("lower", lower), ("upper", upper))}
    return F.struct(*(v.alias(k) for k, v in {**limits, "empty": (tp == 0) & (fp == 0) & (t == 0), **counts, **rates}.items()))


#: Types whose true negatives a report has; all together have them too.
TN_TYPES = ("SNP", "Insertion", "Deletion")


def report_records(outcomes: DataFrame, breaks: tuple[int, ...] = C.SIZE_BREAKS, sv_length: int = C.SV_LENGTH, non_n: int | None = None) -> DataFrame:
    """(overall_type, record) for each type and All: cells of all bins in order, of the bins of items of at least
    sv_length, the sums of both, and sums of bases, with true negatives for TN_TYPES and All if the genome's bases
    are known. outcomes: as for the counts. Without outcomes there is one row of zeros, All."""
    is_ = lambda *n: F.col("outcome").isin(*n)
    sized = outcomes.select(F.explode(F.array("overall_type", F.lit("All"))).alias("kind"), "outcome", F.col("len").cast("long").alias("len"), (F.col("overall_type") == "Insertion").alias("ins"))
    sv = F.col("len") >= sv_length
    counts = {"tp": is_("TP"), "fp": is_("FP"), "t": is_("TP", "FN")}
    sums = [F.count_if(v).alias(k) for k, v in counts.items()] + [F.count_if(v & sv).alias(f"sv_{k}") for k, v in counts.items()]
    bases = [F.sum(F.when(v & ~(F.col("ins") if k == "t" else F.lit(False)), F.col("len")).otherwise(0)).alias(f"b_{k}") for k, v in counts.items()]
    counted = sized.groupBy("kind", C.size_bin(F.col("len"), breaks).alias("bin")).agg(*sums, *bases)
    names = [f"{p}{k}" for p in ("", "sv_", "b_") for k in counts]
    spark = outcomes.sparkSession
    kinds = counted.select("kind").union(spark.range(1).select(F.lit("All"))).distinct()
    grid = kinds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(breaks)))))
    full = grid.join(counted, ["kind", "bin"], "left").fillna(0, names)
    lows, highs = F.array(*map(F.lit, (1, *(b + 1 for b in breaks)))), F.array(*map(F.lit, (*breaks, -1)))
    limits = {"lower": F.element_at(lows, F.col("bin") + 1), "upper": F.element_at(highs, F.col("bin") + 1)}
    cell = lambda p: _cell(*(F.col(f"{p}{k}") for k in counts), **limits)
    ordered = lambda p: F.transform(F.array_sort(F.collect_list(F.struct("bin", cell(p).alias("c")))), lambda x: x["c"])  # noqa: E731  one for each bin
    per = full.groupBy(F.col("kind").alias("overall_type")).agg(ordered("").alias("bin_counts"), ordered("sv_").alias("sv_bin_counts"), *(F.sum(n).alias(n) for n in names))
    tn = F.when(F.col("overall_type").isin(*TN_TYPES, "All"), F.lit(non_n) - F.col("b_t") - F.col("b_fp")) if non_n is not None else None
    whole = lambda p, tn=None: _cell(*(F.col(f"{p}{k}") for k in counts), tn)
    return per.select("overall_type", F.struct("bin_counts", "sv_bin_counts", whole("").alias("sum_count"), whole("sv_").alias("svSumCount"), whole("b_", tn).alias("sum_per_base_count"), F.array(*map(F.lit, breaks)).alias("bin_breaks")).alias("record"))


def distance_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, max, min, mean, sum, sample variance, quantiles at (n + 1) p, and how many are 0, 1 and 2.

    Values are counted first, so the running count is over different values only.
    """
    v, n = F.col(value), F.col("__k")
    counted = rows.filter(v.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__to", F.sum("__k").over(order)).withColumn("__n", F.sum("__k").over(Window.partitionBy(*by)))

    def quantile(p: float) -> Column:
        at = (F.col("__n") + 1) * p
        value_at = lambda i: F.min(F.when(F.col("__to") >= F.least(F.greatest(i, F.lit(1)), F.col("__n")), v.cast("double")))
        inside = F.max(F.when((at >= 1) & (at < F.col("__n")), at - F.floor(at)).otherwise(0.0))
        return value_at(F.floor(at)) + inside * (value_at(F.floor(at) + 1) - value_at(F.floor(at)))

    total, mean = F.sum(n), F.sum(n * v) / F.sum(n)
    spread = F.sum(n * v * v).cast("double") - F.sum(n * v).cast("double") * F.sum(n * v) / total
    plain = [total.alias("n"), F.max(v).alias("max"), F.min(v).alias("min"), mean.alias("mean"), F.sum(n * v).alias("sum"), F.when(total > 1, spread / (total - 1)).alias("variance")]
    some = [F.sum(F.when(v == i, n).otherwise(0)).alias(f"n_{i}") for i in (0, 1, 2)]
    return ranked.groupBy(*by).agg(*plain, *(quantile(p / 100).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)), *some)


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of at most ``bins`` equal widths between the least and largest value."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.least(F.lit(bins), F.count(value)).alias("k"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * F.col("k") / (F.col("hi") - F.col("lo"))), F.col("k") - 1)).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).filter(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def count_by_allele_type(variants: DataFrame, lo: int, hi: int) -> DataFrame:
    """How many of each type (chr, file_no, rec_no, pos, overall_type, len, gt_p, gt_m): two for a
    heterozygous variant of two alleles, one otherwise; adjacent repeats and lengths outside are left out."""
    once = drop_adjacent_dups(variants, ("pos", "overall_type", "len", "alt"))
    inside = once.filter(F.col("len").between(lo, hi))
    alleles = F.when(F.col("gt_p") == F.col("gt_m"), 1).otherwise(2)
    return inside.groupBy("overall_type").agg(F.sum(alleles).cast("long").alias("n"))


# The allele types that are counted by name.
COUNTED_TYPES = ("SNP", "Insertion", "Deletion", "MNP", "Inversion", "Interspersed_Duplication", "Translocation_Duplication", "Tandem_Duplication", "Complex")


def count_alleles(variants: DataFrame, lo: int, hi: int) -> DataFrame:
    """(kind, n): alleles of each of COUNTED_TYPES (both of a heterozygous variant, one of a homozygous one, the
    reference allele too, which is ``other`` as all types not counted by name are), and variants ``out of range``
    and in ``all``. variants: canonical rows; those equal to the one before count in neither."""
    same = ("pos", "ref", "ref_len", "alts", "gt_p", "gt_m", "id")
    once = drop_adjacent_dups(variants, same)
    eff = C.effective_alleles(F.col("gt_p"), F.col("gt_m"), F.size("alts"), F.col("chr"))
    size = lambda g: F.when(g > 0, F.greatest("ref_len", F.try_element_at("alts", F.when(g > 0, g))["alt_len"])).otherwise(0)
    rows = once.withColumn("e", eff)
    outside = (F.greatest(size(F.col("e.p")), size(F.col("e.m"))) > hi) | (F.least(size(F.col("e.p")), size(F.col("e.m"))) < lo)
    kind = lambda g: F.coalesce(F.try_element_at("alts", F.when(g > 0, g))["allele_type"], F.lit("Reference"))
    named = lambda k: F.when(k.isin(*COUNTED_TYPES), k).otherwise("other")
    both = F.when(F.col("e.p") == F.col("e.m"), F.array(named(kind(F.col("e.p"))))).otherwise(F.array(named(kind(F.col("e.p"))), named(kind(F.col("e.m")))))
    return rows.select(F.explode(F.when(outside, F.array(F.lit("out of range"))).otherwise(F.concat(F.array(F.lit("all")), both))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def drop_adjacent_dups(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ("chr",), order: tuple[str, ...] = ("rec_no",)) -> DataFrame:
    """Rows that differ from their predecessor in order, within each group of ``by``."""
    rows = scanned(in_order(df, [*by, *order]), by, previous={"__before": F.struct(*keys)})
    return rows.filter(~F.col("__before").eqNullSafe(F.struct(*keys))).drop("__before")


def vcf_totals(variants: DataFrame) -> DataFrame:
    """Variants and bases per file."""
    return variants.groupBy("file_no").agg(F.count("*").alias("n"), F.sum("bases").alias("bases"))
