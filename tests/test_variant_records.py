"""Ordered decisions, running values, reports, cohorts, files by content, and jobs that no query goes through."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators import alignments, cohort, intervals, liftover, mapbuild, match, scan, stats
from verisect.plans import jobs
from verisect.sources import sinks, text, vcf

HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"


def line(c, p, r, a, i=".", g="0|1", form="GT"):
    return f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t{i}\t{form}\t{g}\n"


# -- decisions in order --------------------------------------------------------------------------------------


def chosen(pieces, used, genotype):
    """What each piece takes; pieces: piece -> (hom, [(truth, hom, n_p, n_m)])."""
    out = {}
    for piece, (c_hom, found) in pieces.items():
        free = sorted(x for x in found if x[0] not in used)
        hom = [x[0] for x in free if x[1]]
        p, m = [x for x in free if not x[1] and x[2]], [x for x in free if not x[1] and x[3]]
        both = [x[0] for x in p if x in m]
        het = both or [x[0] for x in (p if sum(x[2] for x in p) > sum(x[3] for x in m) else m)]
        pick = (hom if c_hom else het) if genotype else hom or het
        if pick:
            out[piece] = pick[0]
    return out


def replayed(calls, genotype=False, need=None):
    used, out = set(), set()
    for call in sorted(calls):
        taken = chosen(calls[call], used, genotype)
        if need is None or len(taken) == need[call]:
            out |= {(call, p, t) for p, t in taken.items()}
            used |= set(taken.values())
    return out


@pytest.mark.parametrize("seed, genotype, whole", [(1, False, False), (2, True, False), (3, False, True), (4, True, True)])
def test_haplotype_lists_in_order(spark, seed, genotype, whole):
    rng = random.Random(seed)
    hom = {t: rng.random() < 0.4 for t in range(14)}
    calls = {}
    for call in range(18):
        for piece in range(rng.randrange(1, 3)):
            found = {t: (t, hom[t], rng.randrange(3), rng.randrange(3)) for t in rng.sample(range(14), rng.randrange(1, 4))}
            calls.setdefault(call, {})[piece] = (rng.random() < 0.4, list(found.values()))
    need = {c: len(p) for c, p in calls.items()} if whole else None
    rows = [(c, c, p, t, t, ch, th, n, m) for c, ps in calls.items() for p, (ch, ts) in ps.items() for t, th, n, m in ts]
    edges = spark.createDataFrame(rows, "call int, call_order int, piece int, truth int, truth_order int, c_hom boolean, t_hom boolean, n_p int, n_m int")
    pieces = spark.createDataFrame(list(need.items()), "call int, pieces int") if whole else None
    got = {(r.call, r.piece, r.truth) for r in match.ordered_match(edges, pieces, genotype).collect()}
    assert got == replayed(calls, genotype, need)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each call shares a truth with the one before: 20,000 calls in two rounds and some doubling."""
    rng = random.Random(5)
    calls = {i: {0: (True, [(t, True, 0, 0) for t in ((i, i + 1) if rng.random() < 0.999 else (i,))])} for i in range(20_000)}
    edges = spark.createDataFrame([(c, c, 0, t[0], t[0]) for c, p in calls.items() for t in p[0][1]], "call int, call_order int, piece int, truth int, truth_order int")
    rounds = []
    plain = match._rivals
    monkeypatch.setattr(match, "_rivals", lambda left: rounds.append(1) or plain(left))
    got = {(r.call, r.piece, r.truth) for r in match.greedy_match(edges).collect()}
    assert got == replayed(calls) and len(rounds) <= 3


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_conflicts_are_the_ordered_loop(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(260):
        kind = rng.choice(["SNP", "Deletion", "Insertion", "Inversion"])
        size = {"SNP": 1, "Insertion": 0}.get(kind, rng.randrange(1, 8))
        rows.append((i, rng.choice("ab"), rng.randrange(2, 300 + 900 * (seed == 1)), size, 3, kind, "" if kind == "SNP" or seed == 0 else rng.choice(["", "A"])))
    changed, deleted, inserted, want = set(), set(), set(), set()
    for rec, chr_, pos, size, _, kind, _ in sorted(rows, key=lambda v: (v[2] - len(v[6]), v[0])):
        span = {(chr_, p) for p in range(pos, pos + size)}
        if size == 0:
            ok = (chr_, pos) not in inserted and not {(chr_, pos), (chr_, pos - 1)} <= deleted
            inserted |= {(chr_, pos)} if ok else set()
        else:
            ok = not changed & span
            changed |= span if ok else set()
            deleted |= span if ok and kind == "Deletion" else set()
        want |= {rec} if ok else set()
    df = spark.createDataFrame(rows, "rec_no long, chr string, pos long, ref_len int, ins_len int, overall_type string, ref_deleted string")
    assert {r.rec_no for r in mapbuild.drop_conflicts(df).collect()} == want


def test_running_values(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = scan.scanned(scan.in_order(df, ["g", "i"]), ("g",), sums={"s": F.coalesce("v", F.lit(0))}, maxes={"m": F.col("v")}, previous={"p": F.col("v")}, following={"f": F.col("v")}, last={"l": F.col("v")})
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r.i):
        seen.setdefault(r.g, []).append(r)
    for g, mine in seen.items():
        values = [v for x, _, v in rows if x == g]
        for k, r in enumerate(mine):
            before = [v for v in values[:k] if v is not None]
            known = [v for v in values[: k + 1] if v is not None]
            assert (r.v, r.s, r.m, r.p, r.f, r.l) == (values[k], sum(before), max(before, default=None), values[k - 1] if k else None, values[k + 1] if k + 1 < len(values) else None, known[-1] if known else None)


def test_sweeps(spark):
    rng = random.Random(6)
    sets = [[(rng.choice("xy"), s, s + rng.randrange(-1, 30)) for s in (rng.randrange(1, 300) for _ in range(25))] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "chr string, start long, end long") for s in sets)
    cover = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e + 1)}
    for got, want in ((intervals.intersect_intervals(a, b), cover(sets[0]) & cover(sets[1])), (intervals.subtract_intervals(a, b), cover(sets[0]) - cover(sets[1]))):
        rows = [tuple(r) for r in got.collect()]
        assert cover(rows) == want and sum(e - s + 1 for _, s, e in rows) == len(want)


# -- reports and cohorts -------------------------------------------------------------------------------------

# A report of one inserted base that was found.
NONE = {"empty": True, "t": 0, "fp": 0, "tn": 0, "tpr": "NaN", "fdr": "NaN", "ppv": "NaN", "spc": "NaN", "fn": 0, "tp": 0, "f1": "NaN", "_TP": 0, "_FP": 0, "_TN": 0, "_FN": 0, "_T": 0}
FOUND = {"empty": False, "t": 1, "fp": 0, "tn": 0, "tpr": 1.0, "fdr": 0.0, "ppv": 1.0, "spc": "NaN", "fn": 0, "tp": 1, "f1": 1.0, "_TP": 1, "_FP": 0, "_TN": 0, "_FN": 0, "_T": 1}
BASES = {"empty": False, "t": 0, "fp": 0, "tn": 0, "tpr": "Infinity", "fdr": 0.0, "ppv": 1.0, "spc": "NaN", "fn": 0, "tp": 1, "f1": "NaN", "_TP": 1, "_FP": 0, "_TN": 0, "_FN": 0, "_T": 0}
LIMITS = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10), (11, 19), (20, 29), (30, 39), (40, 49), (50, 99), (100, 199), (200, 399), (400, 799), (800, 1599), (1600, 3199), (3200, 6399), (6400, 12799), (12800, 25599), (25600, 51199), (51200, 102399), (102400, 500000), (500001, 1000000), (1000001, -1)]


def test_the_report_of_one_insertion(spark, tmp_path):
    for name, g in (("t", "0/1"), ("c", "1/0")):
        (tmp_path / f"{name}.vcf").write_text(HEAD + line("1", 993, "C", "CA", "SVLEN=1", g))
    truth, calls = (vcf.read_vcf(spark, str(tmp_path / f"{n}.vcf"))[0] for n in "tc")
    outcomes = jobs.compare_variants(truth, calls, match_geno=True)["outcomes"]
    got = json.loads(jobs.comparison_report(outcomes, {"wiggle": 20, "overlap_percent": 0.8}).first().value)
    assert got["params"] == {"wiggle": 20, "overlap_percent": 0.8}
    limited = lambda cell, lower, upper: {**cell, "lower": lower, "upper": upper}
    want = {"bin_counts": [limited(NONE if k else FOUND, *x) for k, x in enumerate(LIMITS)], "sv_bin_counts": [limited(NONE, *x) for x in LIMITS], "sum_count": limited(FOUND, -1, -1), "svSumCount": limited(NONE, -1, -1), "sum_per_base_count": limited(BASES, -1, -1), "bin_breaks": [x[1] for x in LIMITS[:-1]]}
    assert got["num_true_correct"] == {"data": {"Insertion": want}, "all_data": want}
    chunks = spark.createDataFrame([("1", 1, "ACGTN")], "contig string, start long, bases string")
    with_tn = json.loads(jobs.comparison_report(outcomes, {}, chunks, spark.createDataFrame([("1", 2, 9), ("1", 4, 5)], "chr string, start long, end long")).first().value)
    assert with_tn["num_true_correct"]["all_data"]["sum_per_base_count"]["tn"] == 3
    sinks.write_partitioned(outcomes, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"outcome=TP"}


def test_an_empty_report(spark):
    none = spark.createDataFrame([], "overall_type string, len int, outcome string")
    rows = stats.report_records(none).collect()
    assert [(r.overall_type, r.record.sum_count["empty"], len(r.record.bin_counts)) for r in rows] == [("All", True, 28)]


def test_a_cohort_of_files(spark, tmp_path):
    """Three samples have both files; one has no calls, one no truth."""
    site = {"a": 10, "b": 20, "c": 30, "d": 40}
    files = {"truth": ["a", "b", "c", "d"], "calls": ["a", "b", "c", "e"]}
    frames = []
    for side, samples in files.items():
        for s in samples:
            pos = site.get(s, 50) + (5 if (side, s) == ("calls", "c") else 0)
            (tmp_path / f"{side}-{s}.vcf").write_text(HEAD + line("1", pos, "A", "C") + line("1", 500, "G", "T"))
        frames.append(spark.createDataFrame([(s, str(tmp_path / f"{side}-{s}.vcf")) for s in samples], "sample string, path string"))
    truth, calls = jobs.read_cohort(spark, *frames)
    assert {r.sample for r in truth.select("sample").distinct().collect()} == {"a", "b", "c"}
    out = jobs.validate_cohort(truth, calls)
    assert {(r.sample, r.tp, r.fp, r.t) for r in out["counts"].collect()} == {("a", 2, 0, 2), ("b", 2, 0, 2), ("c", 1, 1, 2)}
    total = {r.grp: r for r in out["totals"].collect()}["snp"]
    assert (total.tp, total.fp, total.t, total.fn) == (5, 1, 6, 1)
    spread = out["spread"].first()
    assert spread.n == 3 and abs(spread["mean"] - 2.5 / 3) < 1e-9


def test_augmenting(spark):
    schema = "rec_no long, chr string, pos long, ref string, alt string, ref_len int, overall_type string, len int"
    row = lambda i, pos: (i, "1", pos, "A", "C", 1, "SNP", 1)
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    out = jobs.augment_and_summarise(df(row(1, 10)), df(row(7, 20), row(8, 30)), df(row(2, 21), row(3, 90)), df(row(2, 21)), df(row(7, 20)))
    assert {k: sorted(r.pos for r in out[k].collect()) for k in ("TP", "T", "FN", "FP")} == {"TP": [10, 21], "T": [10, 21, 90], "FN": [90], "FP": [30]}
    total = {r.overall_type: (r.tp, r.fp, r.t) for r in out["by_type"].collect()}
    assert total == {"SNP": (2, 1, 3), "All": (2, 1, 3)}
    regions = spark.createDataFrame([("1", 1, 25)], "chr string, start long, end long")
    inside = jobs.augment_and_summarise(df(row(1, 10)), df(row(8, 30)), df(row(3, 90)), regions=regions, breaks=(1, 5))
    assert [(r.overall_type, r.tp, r.fp, r.t) for r in inside["by_type"].collect() if r.overall_type == "All"] == [("All", 1, 0, 1)]
    assert sorted(r.bin for r in inside["by_bin"].collect()) == [0, 1, 2]
    false = jobs.augment_and_summarise(None, df(row(8, 30)), None)
    assert [(r.tp, r.fp, r.t) for r in false["by_type"].filter("overall_type = 'All'").collect()] == [(0, 1, 0)]


# -- files ---------------------------------------------------------------------------------------------------


def test_gzip_by_content_and_order_of_paths(spark, tmp_path):
    """The largest file is scanned first, but lines are numbered in order of paths; a gzip file needs no name."""
    lots = "".join(line("1", 100 + i, "A", "C") for i in range(2000))
    (tmp_path / "a.vcf").write_text(HEAD + line("1", 1, "A", "C"))
    packed = (HEAD + line("1", 2, "A", "C") + line("1", 3, "A", "C")).encode()
    (tmp_path / "b.vcf").write_bytes(gzip.compress(packed[:70]) + gzip.compress(packed[70:]))  # two members
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress((HEAD + lots).encode()))
    (tmp_path / "d.vcf").write_text(HEAD + line("1", 9000, "A", "C"))
    good, bad = vcf.read_vcf(spark, str(tmp_path))
    rows = good.orderBy("rec_no").select("source", "pos", "rec_no").collect()
    assert bad.count() == 0 and [r.pos for r in rows] == [1, 2, 3, *range(100, 2100), 9000]
    assert [r.source for r in rows[:4]] == ["a.vcf", "b.vcf", "b.vcf", "c.vcf.gz"]
    assert rows[0].rec_no == 1 and rows[-1].rec_no == 2 + 3 + 2001 + 1
    assert vcf.read_vcf(spark, [str(tmp_path / "b.vcf"), str(tmp_path / "a.vcf")])[0].count() == 3
    assert jobs.count_variants(spark, str(tmp_path / "a.vcf")) == 1


def test_genomes_over_parts_of_files(spark, tmp_path):
    """Lines of a contig lie in several parts of a file, and a contig's name comes twice."""
    rng = random.Random(2)
    wanted, body = {}, ["no contig yet\n"]
    for name in ("c1", "c2", "c3"):
        bases = "".join(rng.choice("ACGTN") for _ in range(3000))
        wanted[name] = bases
        body += [f">{name} more words\n", *(bases[i : i + 50] + "\n" for i in range(0, 3000, 50)), "\n"]
    (tmp_path / "g.fa").write_text("".join(body))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        chunks = text.read_fasta(spark, str(tmp_path / "g.fa"), chunk=256).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {}
    for r in sorted(chunks, key=lambda r: (r.contig, r.chunk_no)):
        got[r.contig] = got.get(r.contig, "") + r.bases
    assert got == wanted


def test_structural_fields_survive_a_file(spark, tmp_path):
    rows = [
        line("1", 50, "A", "<DUP:TANDEM>", "SVLEN=20", "0|1:1|4", "GT:CN"),
        line("1", 80, "A", "<DUP:ISP>", "SVLEN=5;CHR2=2;POS2=7;END2=11;ISINV", "1|1:2|2", "GT:CN"),
        line("1", 90, "A", "<DUP:TRA>", "SVLEN=4;TRAID=x;CHR2=2;POS2=17;END2=20", "0|1"),
        line("2", 16, "A", "<DEL:TRA>", "SVLEN=-4;TRAID=x", "0|1"),
        line("2", 60, "A", "<INV>", "SVLEN=9", "1/1"),
        line("X", 70, "A", "C", ".", "1"),
        line("2", 99, "A", "G", ".", "./."),
    ]
    (tmp_path / "a.vcf").write_text(HEAD + "".join(rows))
    first, bad = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))
    bare = first.withColumn("info_raw", F.lit("."))  # so that INFO comes from the row
    vcf.write_vcf(bare, str(tmp_path / "out"))
    again, worse = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert bad.count() == worse.count() == 0
    keep = ["chr", "pos", "ref_len", "overall_type", "max_len", "gt_p", "gt_m", "chr2", "pos2", "end2", "traid", "is_inv", F.transform("alts", lambda a: a["cn"]).alias("cn")]
    assert sorted(map(str, again.select(keep).collect())) == sorted(map(str, first.select(keep).collect()))
    lines = sorted(r.value.split("\t")[7:] for r in spark.read.text(str(tmp_path / "out")).collect() if "VARIANT_OVERALL_TYPE=" in r.value and not r.value.startswith("#"))
    assert ["VARIANT_OVERALL_TYPE=TandemDup;SVTYPE=DUP;SVLEN=20", "GT:CN", "0|1:1|4"] in lines
    assert ["VARIANT_OVERALL_TYPE=InterDup;SVTYPE=DUP;SVLEN=5;CHR2=2;POS2=7;END2=11;ISINV", "GT:CN", "1|1:2|2"] in lines
    counts = {r.kind: r.n for r in stats.count_alleles(first, 0, 15).collect()}
    assert counts == {"all": 6, "out of range": 1, "Interspersed_Duplication": 1, "Translocation_Duplication": 1, "other": 4, "Inversion": 1, "SNP": 2}


def test_lines_and_fields(spark, tmp_path):
    (tmp_path / "m.vcf").write_text("##x\n" + HEAD.rstrip("\n") + "\tu\n" + "1\t5\trs\tA\tC\t9\tq\tA=1;A=2;DP=7\tGT:DP\t./.:3\t1|1:4\n1\t6\trs\tA\tC\t9\tq\tDP=7\n")
    lines = text.read_lines(spark, str(tmp_path / "m.vcf"))
    picked = [r.value for r in vcf.select_samples(lines, [1]).orderBy("rec_no").collect()]
    assert picked[0] == "##x" and picked[1].endswith("FORMAT\tu") and picked[2].endswith("GT:DP\t1|1:4")
    parsed = vcf.parse_lines(lines)
    assert [r.x for r in parsed.orderBy("rec_no").select(vcf.get_field("DP").alias("x")).collect()] == ["3", "7"]
    clean = vcf.clean_variants(parsed).collect()
    assert [(r.id, r.qual, r["filter"], r.info_raw, r["sample"]) for r in clean] == [(".", ".", ".", ".", "0/1:3")]
    (tmp_path / "d.txt").write_text("\t".join(text.DGV_COLUMNS) + "\n" + "\t".join(["v1", "1", "3", "9", "CNV", "deletion", *[""] * 14]) + "\n")
    chunks = spark.createDataFrame([("1", 1, "ACGT"), ("1", 5, "TTGA")], "contig string, start long, bases string")
    assert [(r.allele_type, r.anchor) for r in text.read_dgv(spark, str(tmp_path / "d.txt"), chunks, 4).collect()] == [("Deletion", "C")]
    (tmp_path / "r.bed").write_text("1\t10\t30\tr1\t0\t+\n1\t40\t50\tr1\t0\t-\n2\t0\t9\tr2\t0\t+\n")
    reads = text.read_map_from_bed(spark, str(tmp_path / "r.bed"))
    assert sorted((r.read_name, r.chr, r.start, r.end, r.strand, r.read_end) for r in reads.collect()) == [("r1", "1", 40, 50, "-", 10), ("r2", "2", 0, 9, "+", 9)]


# -- jobs ----------------------------------------------------------------------------------------------------


def test_lifts_of_maps(spark):
    schema = "block_no int, size long, src_chr string, src_loc long, dst_chr string, dst_loc long, direction string, feature string"
    blocks = spark.createDataFrame([(1, 20, "a", 1, "1_101_200", 5, "+", "SEQ"), (2, 20, "a", 21, "1", 9, "-", "INV")], schema)
    assert [(r.dst_chr, r.dst_loc) for r in liftover.lift_region_map(blocks).collect()] == [("1", 105)]
    reads = spark.createDataFrame([("r", 0, 0, "a", 0, 40, "+", "SEQ", 0, 40)], "read_name string, mate int, block_no int, chr string, start long, end long, strand string, feature string, read_start long, read_end long")
    got = jobs.lift_read_map(reads, blocks)
    assert sorted((r.chr, r.start, r.end, r.strand, r.feature, r.read_start, r.read_end) for r in got.collect()) == [("1", 8, 28, "-", "INV", 21, 40), ("1_101_200", 4, 24, "+", "SEQ", 1, 20)]


def test_building_a_map_and_sampling(spark):
    v = spark.createDataFrame([(i, "1", 10 * i, 3, 3, "Deletion", 2, "A", 3) for i in range(1, 9)] + [(20, "1", 11, 1, 1, "SNP", 2, "A", 1), (21, "1", 90, 1, 1, "SNP", 2, "A", 1)], "rec_no long, chr string, pos long, ref_len int, ins_len int, overall_type string, cn int, ref string, max_len int")
    lengths = spark.createDataFrame([("1", 100), ("2", 7)], "contig string, length long")
    got = jobs.build_map(v, lengths, "_maternal")
    sizes = {}
    for r in got.collect():
        sizes[r.src_chr, r.feature] = sizes.get((r.src_chr, r.feature), 0) + r["size"]
    assert sizes == {("1_maternal", "SEQ"): 76, ("1_maternal", "DEL"): 24, ("2_maternal", "SEQ"): 7}
    some = jobs.sample_variants(v, {"Deletion": 3, "SNP": 9}, hi=3)
    assert sorted(r.overall_type for r in some.collect()) == ["Deletion"] * 3 + ["SNP"] * 2
    many = spark.createDataFrame([(1, "1", 15, 1, ["0|1", "1|1", "0|0"])], "rec_no long, chr string, pos long, ref_len int, samples array<string>")
    regions = spark.createDataFrame([("1", 11, 60)], "chr string, start long, end long")
    assert [(r.pos, r.samples) for r in jobs.restrict_cohort(many, regions, samples=[2, 0], short_names=True).collect()] == [(5, ["0|0", "0|1"])]


def test_small_helpers(spark, tmp_path):
    values = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert {r.bin: r.n for r in stats.histogram(values, "v", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    r = spark.range(1).select(C.max_nn(F.lit(None).cast("int"), F.lit(3)).alias("m"), C.breakend_like(*(F.struct(F.lit("1").alias("chr"), F.lit(p).alias("pos"), F.lit(True).alias("left"), F.lit(True).alias("forward")) for p in (5, 9)), 4).alias("near")).first()
    assert (r.m, r.near) == (3, True)
    rows = spark.createDataFrame([("r1", "FP", False, ["All", "Sequence"]), ("r2", "TP", True, ["All"])], "read_name string, status string, tum boolean, features array<string>")
    alignments.write_fp_alignments(rows, str(tmp_path / "fp"))
    assert any(p.is_dir() for p in (tmp_path / "fp").iterdir())
    one = spark.createDataFrame([(1, "x"), (2, "y")], "rec_no long, ref string").select(F.struct("rec_no", "ref").alias("row"))
    both = one.agg(F.collect_list("row").alias("members"))
    assert sorted(r.rec_no for r in vcf.explode_composites(both).collect()) == [1, 2]
    pairs = cohort.pair_samples(spark.createDataFrame([("a", "1"), ("b", "2")], "sample string, path string"), spark.createDataFrame([("b", "3")], "sample string, path string"))
    assert [tuple(x) for x in pairs.collect()] == [("b", "2", "3")]


def test_intermediate_tables_can_be_dropped(spark):
    from pathlib import Path

    from verisect.operators import storage

    kept = storage.stored(spark.range(3))
    folder = Path(storage.new_path(spark).removeprefix("file://").removeprefix("file:")).parent
    assert any(folder.iterdir()) and kept.count() == 3
    storage.drop_stored(spark)
    assert not folder.exists()
    assert storage.stored(spark.range(2)).count() == 2


# -- what each row is worked out for -------------------------------------------------------------------------


def parsed(spark, *lines):
    return vcf.parse_lines(spark.createDataFrame([("f", i, x.rstrip("\n")) for i, x in enumerate(lines)], "file string, rec_no long, value string"))


ALTS = [("A", "C", "."), ("AC", "A", "."), ("A", "ACG", "."), ("C", "ACGC", "."), ("ACGT", "T", "."), ("ACGT", "C", "."), ("A", "A", "."), ("ACC", "AGC", "."), ("A", "<INS>", "SVLEN=0"), ("A", "<DEL>", "SVLEN=-9;X"), ("A", "<DUP>", "SVLEN=9;POS2=4")]


@pytest.mark.parametrize("ref, alt, info", ALTS)
def test_one_alt_as_several(spark, ref, alt, info):
    """One ALT is worked out as compiled columns, several by functions of arrays: the same ALT twice gives the same."""
    size = info.split(";")[0].removeprefix("SVLEN=")
    twice = info.replace(f"SVLEN={size}", f"SVLEN={size},{size}") if info != "." else info
    rows = vcf.normalise(parsed(spark, line("1", 50, ref, alt, info), line("1", 50, ref, f"{alt},{alt}", twice))).orderBy("rec_no").collect()
    one, two = (r.asDict() for r in rows)
    assert {k: v for k, v in one["alts"][0].asDict().items() if k != "alt_idx"} == {k: v for k, v in two["alts"][1].asDict().items() if k != "alt_idx"}
    same = ("pos", "ref", "ref_len", "ref_deleted", "clipped", "overall_type", "max_len", "gt_p", "gt_m", "reject_reason")
    assert {k: one[k] for k in same} == {k: two[k] for k in same}


def test_lines_are_made_once(spark, tmp_path):
    """A written row is worked out once, though its file is in order."""
    (tmp_path / "a.vcf").write_text(HEAD + "".join(line("1", 5 + i, "A", "C") for i in range(50)))
    rows, made = vcf.read_vcf(spark, str(tmp_path / "a.vcf"))[0], spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    vcf.write_vcf(rows.withColumn("id", counted("id")), str(tmp_path / "out"))
    assert made.value == 50
