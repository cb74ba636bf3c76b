"""Whole comparisons with known results."""

import pytest
from pyspark.sql import functions as F

from verisect.operators import setops
from verisect.plans import jobs
from verisect.sources import text, vcf


def variants(spark, tmp_path, name, lines):
    path = tmp_path / f"{name}.vcf"
    path.write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t{i}\tGT\t{g}\n" for c, p, r, a, i, g in lines))
    return vcf.read_vcf(spark, str(path))[0]


def moved(a, pos_a, b, pos_b):
    """Two translocations whose sources and targets are exchanged."""
    return [
        (a, pos_a, "G", "<DEL:TRA>", "SVTYPE=DEL;TRAID=2;SVLEN=-3", "1|1"),
        (a, pos_a, "G", "<DUP:TRA>", "SVTYPE=DUP;TRAID=1;SVLEN=4;CHR2=2;POS2=7;END2=10", "1|1"),
        (b, pos_b, "T", "<DEL:TRA>", "SVTYPE=DEL;TRAID=1;SVLEN=-4", "1|1"),
        (b, pos_b, "T", "<DUP:TRA>", "SVTYPE=DUP;TRAID=2;SVLEN=3;CHR2=1;POS2=9;END2=11", "1|1"),
    ]


def copy_at(pos, size, start, end, more=""):
    return ("1", pos, "A", "<DUP:ISP>", f"SVTYPE=DUP;SVLEN={size};CHR2=1;POS2={start};END2={end}{more}", "0|1")


CASES = {
    "complex": ([("1", 996, "AATG", "AC", ".", "1/1")], [("1", 996, "AAT", "A", ".", "0|1"), ("1", 999, "G", "C", ".", "0|1")], {}, {"truth": ["TP"], "call": ["TP", "TP"]}),
    "mnp": ([("1", 3, "AT", "CG", ".", "1/0")], [("1", 3, "A", "C", ".", "1/0"), ("1", 4, "T", "G", ".", "1/0")], {}, {"truth": ["TP"], "call": ["TP", "TP"]}),
    "genotype": ([("1", 993, "C", "CA", ".", "1/1")], [("1", 993, "C", "CA", ".", "1/0")], {"match_geno": True}, {"truth": ["FN"], "call": ["FP"]}),
    "no genotype": ([("1", 993, "C", "CA", ".", "1/1")], [("1", 993, "C", "CA", ".", "1/0")], {}, {"truth": ["TP"], "call": ["TP"]}),
    "insertion": ([("21", 12893, "A", "<INS>", "SVLEN=100", "1/1")], [("21", 12793, "A", "<INS>", "SVLEN=200", "1/0")], {"wiggle": 150, "ratio": 0.5}, {"truth": ["TP"], "call": ["TP"], "distances": (100, 100, 100)}),
    "partial": ([("1", 6, "AAA", "AG", ".", "1|1")], [("1", 1, "CAA", "CA", ".", "1/1"), ("1", 8, "A", "G", ".", "1/1")], {"disallow_partial": True}, {"truth": ["FN"], "call": ["FP", "FP"]}),
    "translocations": (moved("1", 8, "2", 6), moved("1", 11, "2", 5), {"wiggle": 10}, {"truth": ["TP", "TP"], "call": ["TP", "TP"], "members": [[1, 4], [2, 3]], "kinds": {"Translocation"}}),
    "orientation": ([copy_at(1, 10, 9, 18)], [copy_at(1, 10, 9, 18, ";ISINV")], {"wiggle": 100}, {"truth": ["FN"], "call": ["FP"]}),
    "copied elsewhere": ([copy_at(1, 3, 9, 11)], [copy_at(15, 3, 9, 11)], {"wiggle": 100}, {"truth": ["TP"], "call": ["TP"], "kinds": {"InterDup"}}),
    "copied too far": ([copy_at(1, 3, 9, 11)], [copy_at(15, 3, 9, 11)], {"wiggle": 5}, {"truth": ["FN"], "call": ["FP"]}),
    "half a translocation": (moved("1", 8, "2", 6)[:1], moved("1", 8, "2", 6), {}, {"truth": [], "call": ["FP", "FP"]}),
    "insertion of any length": ([("21", 500, "A", "<INS>", "SVLEN=100", "1/1")], [("21", 505, "A", "<INS>", "SVLEN=900", "1/1")], {"ignore_insertion_length": True}, {"truth": ["TP"], "call": ["TP"]}),
    "equal truths, one call": ([("1", 50, "A", "C", ".", "1/1")] * 2, [("1", 50, "A", "C", ".", "1/1")], {"disallow_partial": True}, {"truth": ["FN", "TP"], "call": ["TP"]}),
    "imprecise call": ([("21", 12893, "A", "<INS>", "SVLEN=100", "1/1")], [("21", 12793, "A", "<INS>", "SVLEN=200;IMPRECISE_LENGTH", "1/0")], {"wiggle": 150, "ratio": 0.5, "ignore_imprecise_length": True}, {"truth": ["TP"], "call": ["TP"], "distances": (100, 100, None)}),
    "imprecise truth": ([("21", 12893, "A", "<INS>", "SVLEN=100;IMPRECISE_LENGTH", "1/1")], [("21", 12793, "A", "<INS>", "SVLEN=200", "1/0")], {"wiggle": 150, "ratio": 0.5, "ignore_imprecise_length": True}, {"truth": ["TP"], "call": ["TP"], "distances": (100, 100, None)}),
    "imprecise but counted": ([("21", 12893, "A", "<INS>", "SVLEN=100;IMPRECISE_LENGTH", "1/1")], [("21", 12793, "A", "<INS>", "SVLEN=200", "1/0")], {"wiggle": 150, "ratio": 0.5}, {"truth": ["TP"], "call": ["TP"], "distances": (100, 100, 100)}),
    "the other haplotype": ([("1", 993, "C", "CA", "SVLEN=1", "0/1")], [("1", 993, "C", "CA", "SVLEN=1", "1/0")], {"match_geno": True}, {"truth": ["TP"], "call": ["TP"]}),
    "no genotype, second base": ([("HXB2", 3161, "G", "T", ".", "1|1")], [("HXB2", 3161, "G", "A,T", ".", "./.")], {}, {"truth": ["TP"], "call": ["TP"]}),
    "bases without a genotype": ([("1", 3, "A", "T", ".", "1/1"), ("1", 4, "C", "T", ".", "0/1")], [("1", 3, "AC", "TC,GT", ".", "./.")], {}, {"truth": ["TP", "TP"], "call": ["TP"]}),
    "homozygous truth first": ([("1", 30, "A", "G", ".", "0/1"), ("1", 30, "A", "G", ".", "1/1")], [("1", 30, "A", "G", ".", "0/1")], {}, {"truth": ["FN", "TP"], "call": ["TP"], "hit": [2]}),
    "heterozygous truth first": ([("1", 30, "A", "G", ".", "1/1"), ("1", 30, "A", "G", ".", "0/1")], [("1", 30, "A", "G", ".", "0/1")], {"match_geno": True}, {"truth": ["FN", "TP"], "call": ["TP"], "hit": [2]}),
    "split": ([("1", 100, "A" + "C" * 150, "G", ".", "1/1")], [("1", 99, "TA" + "C" * 149, "T", ".", "1/1")], {}, {"truth": ["FN", "TP"], "call": ["TP"], "kinds": {"Deletion", "SNP"}}),
}


def cohort(spark, tmp_path, name, files):
    """Variants of one file for each sample."""
    folder = tmp_path / name
    folder.mkdir()
    for sample, lines in files.items():
        (folder / f"{sample}.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t{i}\tGT\t{g}\n" for c, p, r, a, i, g in lines))
    return vcf.read_vcf(spark, str(folder))[0].withColumn("sample", F.regexp_replace("source", r"\.vcf$", ""))


#: Cases of the same options are samples of one comparison.
GROUPS = {}
for _name, _case in CASES.items():
    GROUPS.setdefault(", ".join(f"{k}={v}" for k, v in _case[2].items()) or "plain", []).append(_name)


@pytest.mark.parametrize("group", sorted(GROUPS))
def test_compare(spark, tmp_path, group):
    names = {f"s{i}": n for i, n in enumerate(GROUPS[group])}
    truth, calls = (cohort(spark, tmp_path, side, {s: CASES[n][k] for s, n in names.items()}) for k, side in enumerate("tc"))
    rows = jobs.compare_variants(truth, calls, **CASES[GROUPS[group][0]][2])["outcomes"].collect()
    for sample, case in names.items():
        want, got = CASES[case][3], [r for r in rows if r.sample == sample]
        base = min((n for r in got for n in r.members if r.side == "truth"), default=0) - 1  # record numbers count other lines
        if distances := want.get("distances"):
            assert [(r.d_start, r.d_end, r.d_len) for r in got if r.side == "truth"] == [distances], case
        if members := want.get("members"):
            assert sorted([n - base for n in r.members] for r in got if r.side == "truth") == members, case
        if kinds := want.get("kinds"):
            assert {r.overall_type for r in got if r.side == "truth"} == kinds, case
        if hit := want.get("hit"):
            assert [r.rec_no - base for r in got if r.side == "truth" and r.outcome == "TP"] == hit, case
        for side in ("truth", "call"):
            assert sorted(r.outcome for r in got if r.side == side) == want[side], case


def test_files_of_any_number(spark, tmp_path):
    """Records keep their outcomes whatever number their file has."""
    site = lambda i: ("1", 100 + i, "A", "C", ".", "1/1")
    truth, calls = (setops.concat_files(*[variants(spark, tmp_path, f"{n}{i}", [site(i)]) for i in range(10)]) for n in "tc")
    far = lambda df: df.withColumn("rec_no", F.col("rec_no") + (1 << 60))
    for t, c in ((truth, calls), (far(truth), calls)):
        got = jobs.compare_variants(t, c)["outcomes"]
        assert sorted((r.side, r.outcome) for r in got.collect()) == [("call", "TP")] * 10 + [("truth", "TP")] * 10
        assert got.filter("side = 'truth'").select("rec_no").distinct().count() == 10
    with pytest.raises(Exception, match="no record number"):
        setops.concat_files(far(truth)).collect()


def test_composites_in_regions(spark, tmp_path):
    """All members have to lie in the regions: here those on chromosome 2 don't."""
    regions = spark.createDataFrame([("1", 1, 1000)], "chr string, start long, end long")
    truth, calls = (variants(spark, tmp_path, n, moved("1", a, "2", b)) for n, a, b in (("t", 8, 6), ("c", 11, 5)))
    got = jobs.compare_variants(truth, calls, regions, wiggle=10)["outcomes"].collect()
    assert sorted((r.side, r.outcome) for r in got) == [("call", "TP"), ("call", "TP"), ("truth", "unknown_TP"), ("truth", "unknown_TP")]


@pytest.mark.parametrize("either, want", [(True, "TP"), (False, "unknown_TP")])
def test_one_end_in_regions(spark, tmp_path, either, want):
    regions = spark.createDataFrame([("1", 1, 150)], "chr string, start long, end long")
    truth, calls = (variants(spark, tmp_path, n, [("1", 100, "A", "<DEL>", "SVLEN=-200", "1/1")]) for n in "tc")
    got = jobs.compare_variants(truth, calls, regions, either_end=either)["outcomes"].filter("side = 'truth'").collect()
    assert [r.outcome for r in got] == [want]


def test_alignments(spark):
    reads = spark.createDataFrame([("r1", 0, 0, "1", 105, 60, 0.9), ("r2", 0, 0, "1", 900, 60, 0.9), ("r3", 0, 4, None, None, 0, None), ("r4", 0, 256, "1", 1, 60, 0.9)], "read_name string, mate int, flags int, chr string, pos long, mapq int, identity double")
    read_map = spark.createDataFrame([("r1", 0, 0, "1", 100, 150, "+", "SEQ", 0, 50), ("r2", 0, 0, "1", 100, 150, "+", "SEQ", 0, 50)], "read_name string, mate int, block_no int, chr string, start long, end long, strand string, feature string, read_start long, read_end long")
    out = jobs.compare_alignments(reads, jobs.loci_from_read_map(read_map))
    assert {r.read_name: r.status for r in out["classified"].collect()} == {"r1": "TP", "r2": "FP", "r3": "TN"}
    assert out["by_mapq"].filter("cutoff = 60").first().fp == 1


def test_lift_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("a\t0\t20\tn\t0\t+\n")
    blocks = spark.createDataFrame([(1, 10, "a", 1, "r", 101, "+", "SEQ"), (2, 10, "a", 11, "r", 111, "-", "INV")], "block_no int, size long, src_chr string, src_loc long, dst_chr string, dst_loc long, direction string, feature string")
    got = jobs.lift_bed(text.read_bed_full(spark, str(tmp_path / "a.bed")), blocks).collect()
    assert [(r.chr, r.start, r.end, r.name, r.strand) for r in got] == [("r", 101, 120, "n", ".")]


def test_regions_round_trip(spark):
    v = spark.createDataFrame([(1, "1", 50, 1, "A", "C"), (2, "1", 500, 1, "A", "C")], "rec_no long, chr string, pos long, ref_len int, ref string, alt string")
    regions = spark.createDataFrame([("1", 41, 90), ("1", 80, 120)], "chr string, start long, end long")
    inside = jobs.restrict_cohort(v, regions)
    assert [(r.chr, r.pos) for r in inside.collect()] == [("1_41_120", 10)]
    assert [(r.chr, r.pos) for r in jobs.unrestrict_cohort(inside).collect()] == [("1", 50)]
    assert jobs.combine_variants([v, v.withColumn("alt", F.lit("G"))], "first").count() == 4


def test_comparison_carries_what_it_needs(spark, tmp_path, monkeypatch):
    """Variants are put in order once a side, without the text fields of their lines; without composites no table is
    written for them."""
    truth, calls = (variants(spark, tmp_path, n, [("1", 100 + i, "A", "C", "X=1", "1/1") for i in range(5)]) for n in "tc")
    written = []
    for module in (setops, jobs):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, real=real: written.append(set(df.columns)) or real(df))
    out = jobs.compare_variants(truth, calls)["outcomes"]
    assert sorted((r.side, r.outcome) for r in out.collect()) == [("call", "TP")] * 5 + [("truth", "TP")] * 5
    whole = [c for c in written if "alts" in c]
    assert len(whole) == 2
    assert not any({"info", "info_raw", "alt_text"} & c for c in written)


def test_cohort_stays_where_it_is(spark, tmp_path, monkeypatch):
    """Which samples have both sides is broadcast, so that variants aren't dealt by their few samples."""
    truth, calls = (variants(spark, tmp_path, n, [("1", 100, "A", "C", ".", "1/1")]).withColumn("sample", F.col("chr")) for n in "tc")
    plans, real = [], jobs.compare_variants
    seen = lambda *frames, **options: plans.extend(f._jdf.queryExecution().executedPlan().toString() for f in frames) or real(*frames, **options)
    monkeypatch.setattr(jobs, "compare_variants", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both were large
    try:
        counts = jobs.validate_cohort(truth, calls)["counts"].collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.sample, r.tp, r.fp, r.t) for r in counts] == [("1", 1, 0, 1)]
    assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)
