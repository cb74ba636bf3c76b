"""Whole jobs over variants, alignments, maps and cohorts, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators import alignments as al
from verisect.operators import canonical, cohort, intervals, liftover, mapbuild, match, setops, stats
from verisect.operators.storage import PLACE, numbered, placed, stored
from verisect.sources import sinks, vcf

#: Allele types of copies that stand elsewhere; they are compared by their breakends.
MOVED_COPIES = ("Translocation_Duplication", "Interspersed_Duplication")


def _carried(types: bool = False) -> Column:
    """Alleles that the two haplotypes carry (missing ones filled in), as an array; or their types."""
    eff = C.effective_alleles(F.col("gt_p"), F.col("gt_m"), F.size("alts"), F.col("chr"))
    alleles = F.array(eff["p"], eff["m"])
    if not types:
        return alleles
    return F.transform(F.filter(alleles, lambda g: g > 0), lambda g: F.try_element_at("alts", g)["allele_type"])


def with_composites(variants: DataFrame) -> DataFrame:
    """Variants (and their ``sample``, if there is one) with record, whole, member, members, kind and size.

    record: a dense number in order of sample and rec_no, which the pieces go by from here on, so that rec_no may
    be any number. Two records of one TRAID are a composite: it stands at its second record, its kind is that of
    all its alleles, its size the larger one, members are the rec_no of both. A TRAID's record without a partner
    is half an event and is left out. The number of a record's own TRAID pair is counted within its sample.
    """
    sampled = variants if "sample" in variants.columns else variants.withColumn("sample", F.lit(""))
    rows = setops.number_rows(sampled, ("sample", "rec_no"), "record")
    alone = {"whole": F.col("record"), "member": F.lit(0), "members": F.array("rec_no"), "kind": F.col("overall_type"), "size": F.col("max_len")}
    plain = rows.filter("traid is null").withColumns(alone)
    if not rows.filter("traid is not null").limit(1).count():
        return plain  # numbered rows are a table already
    event = F.concat_ws("\u0001", "sample", "traid")
    joined = rows.filter("traid is not null").withColumns({"original": F.col("rec_no"), "rec_no": F.col("record"), "traid": event})
    pairs = setops.pair_by_traid(joined)
    kinds = canonical.compose_traid(joined.select("rec_no", _carried(True).alias("types")), pairs)
    kinds = kinds.select("traid", "pair", "rec_no", F.col("composite_type").alias("kind"))
    placed = joined.drop("traid").join(kinds, "rec_no").join(pairs.withColumnRenamed("members", "both"), ["traid", "pair"]).drop("pair")
    whole = Window.partitionBy("whole")  # two rows
    placed = placed.withColumn("whole", F.element_at("both", 2)).withColumn("member", (F.array_position("both", F.col("rec_no")) - 1).cast("int"))
    originals = F.transform(F.array_sort(F.collect_list(F.struct("member", "original")).over(whole)), lambda x: x["original"])
    placed = placed.withColumns({"size": F.max("max_len").over(whole), "members": originals, "rec_no": F.col("original")})
    return stored(plain.unionByName(placed.drop("both", "original")))


def breakend_pieces(variants: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Breakends of the haplotypes that carry a dispersed duplication or a translocated deletion; of a variant
    that has both the duplication alone. A duplication without CHR2 has its source on its own chromosome."""
    copies = F.exists(_carried(True), lambda t: t.isin(*MOVED_COPIES))
    each = variants.withColumn("copies", copies).select("*", F.posexplode(_carried()).alias("hap", "allele")).filter("allele > 0")
    kind = F.try_element_at("alts", F.col("allele"))["allele_type"]
    each = each.withColumns({"kind_of": kind, "gt_p": (F.col("hap") == 0).cast("int"), "gt_m": (F.col("hap") == 1).cast("int")})
    source = {c: F.try_element_at(c, F.col("allele")) for c in ("chr2", "pos2", "end2")}
    source["chr2"] = F.coalesce(source["chr2"], F.col("chr"))
    dups = canonical.dup_to_breakends(each.filter(F.col("kind_of").isin(*MOVED_COPIES)).withColumns(source), carry)
    dels = canonical.del_to_breakends(each.filter(~F.col("copies") & (F.col("kind_of") == "Translocation_Deletion")), carry)
    return dups.unionByName(dels).withColumn("piece_no", F.col("piece_no") + 2 * F.col("gt_m"))


#: What a comparison needs of variants.
_COMPARED = ("sample", "rec_no", "chr", "pos", "ref", "ref_len", "alts", "gt_p", "gt_m", "overall_type", "max_len", "imprecise", "traid", "chr2", "pos2", "end2", "is_inv")

#: What pieces keep of their variant.
_CARRY = ("sample", "whole", "member", "imprecise")


def pieces_of(units: DataFrame, ratio: float = 0.8, sv_length: int = C.SV_LENGTH, ignore_insertion_length: bool = False) -> DataFrame:
    """Comparable pieces of rows of with_composites: no (dense, in order of the records), whole, member, unit,
    split, sample, chr, pos, overall_type, ref_len, len, hom, alleles (the haplotypes that carry the piece, with
    their bases; one for both if hom), start, end, imprecise, and the mate's place and orientation of breakends.

    Sequence variants and dispersed ones are taken apart, others are one piece. unit: what has an outcome of its
    own, the whole variant, or each piece of one that is split."""
    units = units.withColumn("rec_no", F.col("record"))
    symbolic = F.exists("alts", lambda a: a["kind"] == "symbolic")
    moved = F.exists(_carried(True), lambda t: t.isin(*MOVED_COPIES, "Translocation_Deletion"))
    seqs = units.filter(~symbolic).withColumn("alts", F.transform("alts", lambda a: a["seq"]))
    cut = stored(canonical.canonicalize(seqs, _CARRY))

    def alleles(p: Column, m: Column, bases) -> Column:
        own = lambda hap, g: F.when(g > 0, F.struct(F.lit(hap).alias("hap"), bases(g).alias("alt")))
        return F.array_compact(F.array(own(0, p), F.when(~F.col("hom"), own(1, m))))

    n_ref, n_alt = F.length("ref"), F.length("alt")
    kind = F.when((n_ref == 1) & (n_alt == 1), "SNP").when(n_ref == 0, "Insertion").when(n_alt == 0, "Deletion").otherwise("Complex")
    base = lambda g: F.when(g == 2, F.coalesce("alt2", "alt")).otherwise(F.col("alt"))
    cut = cut.withColumn("hom", F.col("gt_p") == F.col("gt_m")).select("rec_no", "piece_no", *_CARRY, "chr", "pos", kind.alias("overall_type"), n_ref.alias("ref_len"), F.greatest(n_ref, n_alt).alias("len"), "hom", alleles(F.col("gt_p"), F.col("gt_m"), base).alias("alleles"))
    eff, none = C.effective_alleles(F.col("gt_p"), F.col("gt_m"), F.size("alts"), F.col("chr")), F.lit("")
    rest = units.filter(symbolic & ~moved).withColumns({"hom": C.is_hom(F.col("gt_p"), F.col("gt_m")), "e": eff})
    rest = rest.select("rec_no", F.lit(0).alias("piece_no"), *_CARRY, "chr", "pos", "overall_type", "ref_len", F.col("max_len").alias("len"), "hom", alleles(F.col("e.p"), F.col("e.m"), lambda g: none).alias("alleles"))
    ends = breakend_pieces(units.filter(symbolic & moved), _CARRY).withColumn("hom", F.lit(False))
    ends = ends.select("rec_no", "piece_no", *_CARRY, "chr", "pos", F.lit("Breakend").alias("overall_type"), F.lit(0).alias("ref_len"), F.lit(1).alias("len"), "hom", alleles(F.col("gt_p"), F.col("gt_m"), lambda g: none).alias("alleles"), "mate_chr", "mate_pos", "left", "forward")
    start, end = C.interval_ends(F.col("overall_type"), F.col("pos"), F.col("len"), ignore_insertion_length)
    each = cut.unionByName(rest).unionByName(ends, allowMissingColumns=True).withColumns({"start": start, "end": end})
    # ranges of whole variants in order serve the windows over a variant and the numbers alike
    ranged = placed(each.repartitionByRange("whole").sortWithinPartitions("whole", "member", "piece_no"))
    back = F.col(PLACE[1]) - F.min(PLACE[1]).over(Window.partitionBy("whole"))
    flagged = match.split_flag(ranged.withColumn("back", back), "whole", ratio, sv_length)
    rows = numbered(stored(flagged), "no")
    return rows.withColumn("unit", F.when(F.col("split"), F.col("no")).otherwise(F.col("no") - F.col("back"))).drop("rec_no", "piece_no", "back")


def _by_allele(pieces: DataFrame, prefix: str = "") -> DataFrame:
    """A row for each haplotype that carries a piece, for matching: places of different samples never meet."""
    lane = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\u0001", "sample", c))
    names = ("no", "whole", "overall_type", "ref_len", "len", "pos", "start", "end", "hom", "mate_pos", "left", "forward")
    rows = pieces.select(*names, lane("chr").alias("chr"), lane("mate_chr").alias("mate_chr"), F.explode("alleles").alias("x")).select(*names, "chr", "mate_chr", "x.hap", "x.alt")
    return rows.select(*(F.col(c).alias(f"{prefix}{c}") for c in rows.columns))


def piece_edges(t: DataFrame, c: DataFrame, ratio: float, wiggle: int, sv_length: int, ignore_insertion_length: bool) -> DataFrame:
    """Which truth each call's pieces may take, for match.ordered_match: matches are found haplotype by haplotype
    and counted by the truth's haplotype (n_p, n_m)."""
    truth, calls = _by_allele(t), _by_allele(c, "c_")
    bnd = F.lit("Breakend")
    pairs = match.candidates(truth.filter(F.col("overall_type") != bnd), calls.filter(F.col("c_overall_type") != bnd), ratio, wiggle, sv_length, ignore_insertion_length=ignore_insertion_length, ref_len="ref_len")
    right = calls.filter(F.col("c_overall_type") == bnd)
    right = right.withColumns({f"r_{x}": F.col(f"c_{x}") for x in ("chr", "pos", "mate_chr", "mate_pos", "left", "forward")})
    ends = intervals.breakend_join(truth.filter(F.col("overall_type") == bnd), right, wiggle).select(pairs.columns)
    found = pairs.unionByName(ends)
    count = lambda hap: F.count_if(F.col("hap") == hap)
    return found.groupBy(F.col("c_whole").alias("call"), F.col("c_no").alias("piece"), F.col("no").alias("truth")).agg(F.first("c_hom").alias("c_hom"), F.first("hom").alias("t_hom"), count(0).alias("n_p"), count(1).alias("n_m"), F.first("len").alias("len")).withColumns({"call_order": F.col("call"), "truth_order": F.col("truth")})


def compare_variants(
    truth: DataFrame,
    calls: DataFrame,
    regions: DataFrame | None = None,
    ratio: float = 0.8,
    wiggle: int = 20,
    match_geno: bool = False,
    whole_calls: bool = False,
    disallow_partial: bool = False,
    sv_length: int = C.SV_LENGTH,
    either_end: bool = False,
    ignore_insertion_length: bool = False,
    ignore_imprecise_length: bool = False,
    chunks: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """outcomes (sample, side, rec_no, overall_type, len, outcome, members, and for truth the largest distances),
    counts by type and by bin, and per_base sums, with true negatives if the genome's contig chunks are given.

    A composite has one row, its records are its members; a split variant has one for each piece. Frames with a
    column ``sample`` are compared sample by sample, in one plan. match_geno: homozygous and heterozygous don't
    match; whole_calls: a call matches with all its pieces or not at all; disallow_partial: so it is, and a call
    that matched a truth that is missed in the end is false; either_end: one end in a region will do;
    ignore_insertion_length: insertions are compared by their places; ignore_imprecise_length: variants whose
    length is imprecise have no difference of length.
    """
    t_units, c_units = (with_composites(df.select(*(x for x in _COMPARED if x in df.columns))) for df in (truth, calls))
    t, c = (pieces_of(u, ratio, sv_length, ignore_insertion_length) for u in (t_units, c_units))
    edges = stored(piece_edges(t, c, ratio, wiggle, sv_length, ignore_insertion_length))
    need = c.groupBy(F.col("whole").alias("call")).agg(F.count("*").alias("pieces")) if whole_calls or disallow_partial else None
    taken = match.ordered_match(edges, need, match_geno)
    prefixed = c.select(*(F.col(x).alias(f"c_{x}") for x in c.columns))
    ends = lambda p: C.variant_end(F.col(f"{p}overall_type"), F.col(f"{p}pos"), F.col(f"{p}len"))  # noqa: E731  of variants, not of centred intervals
    hits = taken.select(F.col("piece").alias("c_no"), F.col("truth").alias("no"), "matched").join(t, "no").join(prefixed, "c_no")
    unsure = F.coalesce("imprecise", F.lit(False)) | F.coalesce("c_imprecise", F.lit(False)) if ignore_imprecise_length else F.lit(False)
    length = F.when(~unsure, F.col("c_len") - F.col("len"))
    matched = F.when(F.col("c_hom"), F.col("matched")).otherwise(F.col("c_len"))
    hits = stored(hits.select("unit", "c_unit", matched.alias("len"), "c_len", (F.col("c_pos") - F.col("pos")).alias("d_start"), (ends("c_") - ends("")).alias("d_end"), length.alias("d_len")))

    def total(pieces: DataFrame) -> DataFrame:
        """One row a unit. Each member of a composite has to lie in the regions."""
        if regions is None:
            return pieces.groupBy("unit").agg(F.any_value("whole").alias("whole"), F.any_value("split").alias("split"), F.sum("len").alias("len"), F.min("overall_type").alias("piece_type"))
        spans = pieces.groupBy("unit", "whole", "split", "member", "chr").agg(F.sum("len").alias("len"), F.min("overall_type").alias("piece_type"), F.min("start").alias("start"), F.max("end").alias("end"))
        spans = intervals.point_flags(spans, regions, {"in_start": "start", "in_end": "end"})
        inside = (F.col("in_start") | F.col("in_end")) if either_end else (F.col("in_start") & F.col("in_end"))
        return spans.groupBy("unit", "whole", "split").agg(F.sum("len").alias("len"), F.min("piece_type").alias("piece_type"), F.bool_and(inside).alias("known"))

    truth_out = match.truth_outcome(total(t), match.validated_lengths(hits, "unit"), ratio, "unit")
    found = hits.groupBy(F.col("c_unit").alias("unit")).agg(F.sum("c_len").alias("validated"))
    call_out = match.call_outcome(total(c), found, ratio, "unit")
    if disallow_partial:
        missed = truth_out.filter("outcome = 'FN'").select(F.col("unit").alias("truth"))
        call_out = match.disallow_partial_fp(call_out, hits.select(F.col("c_unit").alias("call"), F.col("unit").alias("truth")), missed, "unit")

    def named(out: DataFrame, units: DataFrame, side: str, distances: list[Column]) -> DataFrame:
        """Outcomes under the names of their records: of a composite its second one, and its own type and size."""
        kinds = units.filter("member = 0").select("whole", "sample", "kind", "size", "members")
        split = F.col("split")
        kind, size = F.when(split, F.col("piece_type")).otherwise(F.col("kind")), F.when(split, F.col("len")).otherwise(F.col("size"))
        return out.join(kinds, "whole").select("sample", F.lit(side).alias("side"), F.element_at("members", -1).alias("rec_no"), kind.alias("overall_type"), size.cast("int").alias("len"), "outcome", "members", *distances)

    names = ("d_start", "d_end", "d_len")
    known, none = [F.col(x).cast("long").alias(x) for x in names], [F.lit(None).cast("long").alias(x) for x in names]
    outcomes = stored(named(truth_out, t_units, "truth", known).unionByName(named(call_out, c_units, "call", none)))
    counted = counted_outcomes(outcomes)
    bases = stats.per_base(counted)
    if chunks is not None:
        bases = stats.true_negatives(bases, stats.non_n_bases(chunks, regions))
    return {
        "outcomes": outcomes, "by_type": stats.with_metrics(stats.confusion_by_type(counted)), "by_bin": stats.confusion_by_bin(counted),
        "sv_bins": stats.confusion_by_bin(counted, sv_length=sv_length), "per_base": bases,
    }


def counted_outcomes(outcomes: DataFrame) -> DataFrame:
    """The outcomes that count: known truth, and false calls."""
    return outcomes.filter("side = 'truth' or outcome = 'FP'").filter(F.col("outcome").isin("TP", "FN", "FP"))


def compare_alignments(alignments: DataFrame, truth: DataFrame, regions: DataFrame | None = None, wiggle: int = 20, mapq: int = 10, identity: float = 1.0, all_alignments: bool = False) -> dict[str, DataFrame]:
    """classified reads, the ladder over mapping qualities, and one for each event. truth: (read_name, mate,
    loci)."""
    rows = alignments if all_alignments else alignments.filter(al.primary_only(F.col("flags")))
    joined = al.truth_loci_join(rows, truth)
    if regions is not None:
        joined = al.in_true_regions(joined, regions)
    classified = al.classify_alignments(joined, wiggle, mapq, identity).withColumn("features", al.events_of(F.col("loci")))
    return {"classified": classified, "by_mapq": stats.confusion_by_mapq(classified), "by_event": stats.confusion_by_event(classified)}


def loci_from_read_map(read_map: DataFrame) -> DataFrame:
    """(read_name, mate, loci) of a read map: where each block's read would start without clipping."""
    loc = F.struct("chr", C.unclipped_true_start(F.col("start"), F.col("read_start")).alias("loc"), "feature")
    return read_map.groupBy("read_name", "mate").agg(F.collect_list(loc).alias("loci"))


def variant_statistics(variants: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Counts per haplotype, type and bin of the non-reference variants: each haplotype by its own allele, and all
    together. With regions each of the three counts only if its own span touches one."""
    rows = stats.haplotype_rows(variants.filter(C.is_nonref(F.col("gt_p"), F.col("gt_m"))))
    if regions is not None:
        rows = intervals.in_regions(stored(rows), regions, ("rec_no", "haplotype"))
    return stats.haplotype_stats(rows)


def lift_bed(bed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each line lifted, its pieces in order and merged; strands are lost. bed: as of read_bed_full."""
    half_open = bed.select("rec_no", "chr", (F.col("start") - 1).alias("start_pos"), F.col("end").alias("end_pos"))
    merged = liftover.lift_merge(liftover.lift_intervals(half_open, blocks))
    lifted = merged.select("rec_no", F.col("piece_chr").alias("chr"), (F.col("piece_start") + 1).alias("start"), F.col("piece_end").alias("end"))
    return lifted.join(bed.select("rec_no", "name", "score"), "rec_no", "left").withColumn("strand", F.lit("."))


def lift_reads(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Loci of reads as text, in the order of their blocks: rec_no, loci."""
    loci = liftover.lift_loci(reads, blocks)
    text = C.format_loc(F.struct(F.col("loc_chr").alias("chr"), "loc", "feature", "direction"))
    each = loci.groupBy("rec_no").agg(F.array_sort(F.collect_list(F.struct("block_no", text.alias("t")))).alias("l"))
    return each.select("rec_no", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("loci"))


def lift_read_map(read_map: DataFrame, blocks: DataFrame, min_len: int = liftover.MIN_READ_OVERLAP) -> DataFrame:
    """A read map lifted block by block; places in the read come from the pieces' running lengths."""
    rows = read_map.withColumn("rec_no", F.xxhash64("read_name", "mate", "block_no")).withColumns({"start_pos": F.col("start"), "end_pos": F.col("end")})
    pieces = liftover.lift_intervals(rows, blocks, min_len, strand="strand")
    named = pieces.join(rows.select("rec_no", "read_name", "mate"), "rec_no")
    return named.select("read_name", "mate", "block_no", F.col("piece_chr").alias("chr"), F.col("piece_start").alias("start"), F.col("piece_end").alias("end"), F.col("piece_strand").alias("strand"), "feature", F.col("read_offset").alias("read_start"), (F.col("read_offset") + F.col("read_len") - 1).alias("read_end"))


def augment_and_summarise(
    tp: DataFrame | None, fp: DataFrame, fn: DataFrame | None, rescued_truth: DataFrame | None = None, rescued_calls: DataFrame | None = None,
    regions: DataFrame | None = None, either_end: bool = False, breaks: tuple[int, ...] = C.SIZE_BREAKS,
) -> dict[str, DataFrame]:
    """TP, T, FN and FP after a second matcher's finds, their summary tables, and counts by type and by bin (of the
    user's breaks). Without truth (tp and fn are None) every call is false. regions: as of counts_from_outcomes."""
    none = fp.limit(0)
    tp, fn, rescued_truth, rescued_calls = (none if x is None else x for x in (tp, fn, rescued_truth, rescued_calls))
    parts = setops.merge_results(tp, fp, fn, rescued_truth, rescued_calls)
    parts = {k: v.drop("file_no") for k, v in parts.items()}
    counted = stored(cohort.counts_from_outcomes(parts["TP"], parts["FP"], parts["FN"], regions, either_end))
    return {**parts, "summary": cohort.summary_tables(counted), "by_type": stats.confusion_by_type(counted), "by_bin": stats.confusion_by_bin(counted, breaks)}


def read_cohort(spark: SparkSession, truth_files: DataFrame, call_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants of truth and calls with their ``sample``, of the samples that have a file (sample, path) on both
    sides. All files of a side are read in one scan; file names must differ within a side."""
    pairs = cohort.pair_samples(truth_files, call_files).collect()  # a row for each sample
    name = lambda path: path.rstrip("/").rsplit("/", 1)[-1]
    out = []
    for side in ("truth_path", "calls_path"):
        names = spark.createDataFrame([(name(r[side]), r["sample"]) for r in pairs], "source string, sample string")
        rows, _ = vcf.read_vcf(spark, [r[side] for r in pairs])
        out.append(rows.join(F.broadcast(names), "source"))
    return tuple(out)


def validate_cohort(truth: DataFrame, calls: DataFrame, **options) -> dict[str, DataFrame]:
    """Counts per sample and type, totals and spread over samples that have truth and calls. Both frames have a
    column ``sample``, by which all samples are compared in one plan."""
    both = lambda a, b: a.join(F.broadcast(b.select("sample").distinct()), "sample", "left_semi")  # noqa: E731  a row for each sample
    outcomes = compare_variants(both(truth, calls), both(calls, truth), **options)["outcomes"]
    counts = stored(stats.confusion_counts(counted_outcomes(outcomes), ("sample", "overall_type")))
    per = counts.withColumn("tpr", C.ratio(F.col("tp"), F.col("t")))
    return {"counts": counts, "totals": cohort.cohort_totals(counts), "spread": cohort.cohort_spread(per, "tpr", ("overall_type",))}


def comparison_report(outcomes: DataFrame, params: dict[str, str | int | float], chunks: DataFrame | None = None, regions: DataFrame | None = None, sv_length: int = C.SV_LENGTH) -> DataFrame:
    """The report of compare_variants' outcomes as one row of JSON, with true negatives if the genome is given."""
    genome = None if chunks is None else stats.non_n_bases(chunks, regions).first()["non_n"]
    return sinks.report_json(stats.report_records(counted_outcomes(outcomes), sv_length=sv_length, non_n=genome), params)


def combine_variants(frames: list[DataFrame], mode: str = "first") -> DataFrame:
    return setops.order_vcf(setops.combine(frames, mode))


def restrict_cohort(variants: DataFrame, regions: DataFrame, flank: int = 0, short_names: bool = False, samples: list[int] | None = None) -> DataFrame:
    """Variants (rec_no, chr, pos, ref_len, ...) inside merged regions, with places counted from them. samples:
    of the column ``samples`` (an array of what each sample has) only these places, from 0, in this order."""
    if samples is not None:
        variants = variants.withColumn("samples", F.array(*(F.try_element_at("samples", F.lit(i + 1)) for i in samples)))
    spans = variants.withColumns({"start": F.col("pos"), "end": F.col("pos") + F.greatest("ref_len", F.lit(1)) - 1})
    inside = intervals.restrict_to_regions(spans, intervals.merge_intervals(regions), flank, short_names)
    return inside.withColumn("pos", F.col("start")).drop("start", "end")


def unrestrict_cohort(variants: DataFrame) -> DataFrame:
    return setops.order_lifted(liftover.lift_region_variants(variants))


def sample_variants(variants: DataFrame, sizes: dict[str, int], lo: int = 1, hi: int = 10**9, seed: int = 0) -> DataFrame:
    """Without adjacent repeats, of lengths in a range, exactly so many of each type."""
    once = stats.drop_adjacent_dups(variants, ("pos", "ref", "overall_type", "max_len"))
    return setops.sample_exact(once.filter(F.col("max_len").between(lo, hi)), sizes, seed=seed)


def build_map(variants: DataFrame, contig_lengths: DataFrame, suffix: str) -> DataFrame:
    """Conflict filter, then the block map of one haplotype."""
    return mapbuild.build_block_map(stored(mapbuild.drop_conflicts(variants, contig_lengths)), contig_lengths, suffix)


def count_variants(spark: SparkSession, path: str) -> int:
    """Data lines of a VCF."""
    return spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("#")).count()
