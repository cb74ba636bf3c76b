"""Reports over samples, constraints, and annotation of false results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import allele_join, endpoints_in_regions, nearest_join

# The groups of a cohort report.
GROUPS = {"all": None, "snp": ("SNP",), "ins": ("Insertion",), "del": ("Deletion",), "indel": ("Insertion", "Deletion")}


def counts_from_outcomes(tp: DataFrame, fp: DataFrame, fn: DataFrame, regions: DataFrame | None = None, either_end: bool = False) -> DataFrame:
    """Rows of ready TP, FP and FN sets under one ``outcome`` column, for the counts of stats. regions: only what
    has both ends of its reference span in some region (or either end) counts; rows then need chr, pos and
    ref_len."""
    rows = tp.withColumn("outcome", F.lit("TP")).unionByName(fp.withColumn("outcome", F.lit("FP"))).unionByName(fn.withColumn("outcome", F.lit("FN")))
    if regions is None:
        return rows
    spans = rows.withColumns({"__start": F.col("pos"), "__end": F.col("pos") + F.greatest("ref_len", F.lit(1)) - 1})
    return endpoints_in_regions(spans, regions, either_end, ("chr", "__start", "__end")).drop("__start", "__end")


def summary_tables(outcomes: DataFrame, sv_length: int = C.SV_LENGTH) -> DataFrame:
    """tp, fp, t, recall, precision and f1 by size class (small, sv, all) and type (and All)."""
    named = outcomes.withColumn("size_class", F.when(F.col("len") >= sv_length, "sv").otherwise("small"))
    is_ = lambda *n: F.count_if(F.col("outcome").isin(*n))
    cube = named.cube("size_class", "overall_type").agg(F.grouping("size_class").alias("gs"), F.grouping("overall_type").alias("gt"), is_("TP").alias("tp"), is_("FP").alias("fp"), is_("TP", "FN").alias("t"))
    out = cube.select(F.when(F.col("gs") == 1, "all").otherwise(F.col("size_class")).alias("size_class"), F.when(F.col("gt") == 1, "All").otherwise(F.col("overall_type")).alias("overall_type"), "tp", "fp", "t")
    m = C.metrics(F.col("tp"), F.col("fp"), F.lit(0), F.col("t"))
    return out.withColumns({"recall": m["tpr"], "precision": m["ppv"], "f1": m["f1"]})


def group_memberships(kind: Column) -> Column:
    """The report groups that a type belongs to, as an array."""
    return F.array_compact(F.array(*(F.lit(g) if kinds is None else F.when(kind.isin(*kinds), g) for g, kinds in GROUPS.items())))


def cohort_totals(counts: DataFrame) -> DataFrame:
    """tp, fp, t, fn and percentages for each report group, over counts (sample, overall_type, tp, fp, t,
    and tn if known)."""
    tn = F.col("tn") if "tn" in counts.columns else F.lit(0)
    each = counts.withColumn("grp", F.explode(group_memberships(F.col("overall_type"))))
    total = each.groupBy("grp").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("t").alias("t"), F.sum(tn).alias("tn"))
    m = C.metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("t"))
    return total.withColumn("fn", F.col("t") - F.col("tp")).withColumns({k: 100 * v for k, v in m.items()})


def spread(values: Column, n: Column) -> dict[str, Column]:
    """mean, median (upper middle) and the element at 5 % of a sorted array."""
    at = lambda q: F.element_at(values, (F.floor(n * (1 - q / 100)) + 1).cast("int"))
    return {"median": at(50.0), "p05_index": at(95.0)}


def cohort_spread(per_sample: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median and p05_index of a value over samples; there is one row per sample, so the lists are
    as long as the cohort."""
    lists = per_sample.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    found = spread(F.col("v"), F.col("n"))
    return lists.select(*by, "n", "mean", *(c.alias(k) for k, c in found.items()))


def pair_samples(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Files (sample, path) of samples that have both."""
    return truth.withColumnRenamed("path", "truth_path").join(calls.withColumnRenamed("path", "calls_path"), "sample")


def check_constraints(constraints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Constraints (name, overall_type, lo, hi, metric, op, cutoff) with their counts, value and whether
    they hold; without a value (0 / 0) they don't."""
    c = F.broadcast(constraints)  # a list of options
    same = (outcomes["overall_type"] == c["overall_type"]) & outcomes["len"].between(c["lo"], c["hi"])
    hits = outcomes.join(c, same).groupBy("name").agg(*(F.count_if(F.col("outcome").isin(*n)).alias(k) for k, n in (("tp", ("TP",)), ("fp", ("FP",)), ("t", ("TP", "FN")))))
    full = constraints.join(hits, "name", "left").fillna(0, ["tp", "fp", "t"])
    m = C.metrics(F.col("tp"), F.col("fp"), F.lit(0), F.col("t"))
    value = F.when(F.col("metric") == "F1", m["f1"]).when(F.col("metric") == "TPR", m["tpr"]).when(F.col("metric") == "FDR", m["fdr"])
    holds = F.when(F.col("op") == "GT", F.col("value") > F.col("cutoff")).otherwise(F.col("value") < F.col("cutoff"))
    return full.withColumn("value", value).withColumn("holds", F.coalesce(holds, F.lit(False)))


def annotate_false(false: DataFrame, caller: DataFrame, master: DataFrame, missed: DataFrame | None = None, within: int = 100) -> DataFrame:
    """False results (rec_no, chr, pos, ref, alt) with the caller's af and dp for the same allele, the
    nearest record of a master list and its distance, and ``purity``: not, if the record is among missed."""
    own = caller.select(*(F.col(c).alias(f"r_{c}") for c in ("rec_no", "chr", "pos", "ref", "alt")), "af", "dp")
    hit = allele_join(false, own)
    with_af = false.join(hit.select("rec_no", "af", "dp"), "rec_no", "left")
    known = master.select(F.col("rec_no").alias("r_rec_no"), F.col("chr").alias("r_chr"), F.col("pos").alias("r_pos"), F.col("id").alias("nearest_id"))
    near = nearest_join(false.select("rec_no", "chr", "pos"), known, within).select("rec_no", "nearest_id", "distance")
    out = with_af.join(near, "rec_no", "left")
    if missed is None:
        return out
    m = missed.select("chr", "pos").distinct().withColumn("__m", F.lit(True))
    return out.join(m, ["chr", "pos"], "left").withColumn("purity", F.when(F.col("__m"), "not").otherwise("pure")).drop("__m")


