"""Small cases with known results, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators import canonical, cohort, intervals, liftover, mapbuild, match, setops, stats
from verisect.sources import sinks, text, vcf


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def pieces(spark, pos, ref, alts, p, m):
    df = spark.createDataFrame([(1, "1", pos, ref, alts, p, m)], "rec_no long, chr string, pos long, ref string, alts array<string>, gt_p int, gt_m int")
    return [(r.pos, r.ref, r.alt, r.alt2, r.gt_p, r.gt_m) for r in canonical.canonicalize(df).orderBy("piece_no").collect()]


def test_canonical_complex_is_deletion_and_snp(spark):
    # AATG > AC at 996, trimmed to ATG > C at 997
    assert pieces(spark, 997, "ATG", ["C"], 1, 1) == [(997, "AT", "", None, 1, 1), (999, "G", "C", None, 1, 1)]


def test_canonical_mnp_is_snps(spark):
    assert pieces(spark, 3, "AT", ["CG"], 1, 0) == [(3, "A", "C", None, 1, 0), (4, "T", "G", None, 1, 0)]


def test_canonical_keeps_snp_and_two_alts(spark):
    assert pieces(spark, 3, "A", ["C"], 0, 1) == [(3, "A", "C", None, 0, 1)]
    assert pieces(spark, 3, "A", ["C", "G"], 1, 2) == [(3, "A", "C", "G", 1, 2)]


def test_canonical_right_end_with_fewer_pieces(spark):
    assert pieces(spark, 10, "AG", ["AGT"], 1, 0) in ([(12, "", "A", None, 1, 0)], [(12, "", "T", None, 1, 0)])


def test_canonical_right_end_with_its_own_bases(spark):
    df = spark.createDataFrame([(1, "1", 10, "AG", ["AGTC"], 1, 0), (2, "1", 10, "AG", ["AGTC", "AGA"], 1, 2)], "rec_no long, chr string, pos long, ref string, alts array<string>, gt_p int, gt_m int")
    kept = lambda exact: [(r.rec_no, r.pos, r.alt) for r in canonical.canonicalize(df, exact_right_end=exact).orderBy("rec_no", "piece_no").collect()]
    assert kept(False)[0] == (1, 12, "AG") and kept(True)[0] == (1, 12, "TC")
    assert (2, 12, "TC") in kept(True) or (2, 12, "A") in kept(True)


def test_overlaps(spark):
    def hit(a, b, ratio, wiggle):
        l1, r1, l2, r2 = map(F.lit, (*a, *b))
        return one(spark, x=C.overlaps(l1, r1, l2, r2, ratio, wiggle)).x

    assert hit((0, 10), (5, 15), 0.5, 0)
    assert not hit((0, 10), (6, 16), 0.5, 0)
    assert hit((0, 10), (6, 16), 0.5, 1)
    assert hit((0, 10), (10, 20), 0.0, 0)
    assert not hit((0, 10), (11, 21), 0.0, 0)
    assert hit((5, 4), (5, 4), 0.5, 0) and not hit((5, 4), (6, 5), 0.5, 0)


def test_variant_interval_of_insertions(spark):
    s, e = C.interval_ends(F.lit("Insertion"), F.lit(1000), F.lit(1))
    assert tuple(one(spark, s=s, e=e)) == (999, 999)
    s, e = C.interval_ends(F.lit("Insertion"), F.lit(1000), F.lit(10))
    assert tuple(one(spark, s=s, e=e)) == (995, 1004)


def test_codecs(spark):
    for alt in ("A[1:99[", "]chr2:7]ACG"):
        assert one(spark, x=C.format_breakend(C.parse_breakend(F.lit(alt)))).x == alt
    for loc in ("chr1-10-", "2--D", "X-5-T-"):
        assert one(spark, x=C.format_loc(C.parse_loc(F.lit(loc)))).x == loc
    name = "1-10-:1-90-:1-10-:1-90-:0:0:1:2:3:4:5:6:17:3/1"
    assert one(spark, x=C.format_read_name(C.parse_read_name(F.lit(name)))).x == name
    info = one(spark, x=C.parse_info(F.lit("SVLEN=-2,3;ISINV;A=1;A=2;."))).x
    assert info == {"SVLEN": "-2,3", "ISINV": "true", "A": "1"}
    assert one(spark, x=C.dedupe_info(F.lit("A=1;B;A=2"))).x == "A=1;B"
    assert one(spark, x=C.rev_comp(F.lit("AACgN"))).x == "NcGTT"


def test_genotypes(spark):
    def gt(g, chr):
        r = one(spark, x=C.parse_gt(F.lit(g), F.lit(chr))).x
        return r.p, r.m, r.phased

    assert gt("0|1", "1") == (0, 1, True)
    assert gt("1", "X") == (-1, 1, False)
    assert gt("1", "chrY") == (1, -1, False)
    assert gt("./1", "1") == (-1, -1, False)


def test_trim_and_clip(spark):
    t = C.trim_prefix(F.lit("ACAAAAG"), F.array(F.lit("ACAG")))
    r = one(spark, t=t, s=C.clip_suffix(t["ref"], t["alts"]))
    assert (r.t.shift, r.t.deleted, r.s.ref, r.s.alts, r.s.clipped) == (3, "A", "AAA", [""], "G")


def random_intervals(spark, n, seed, span, names):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(1, span)
        rows.append((i, rng.choice("ab"), start, start + int(rng.choice((1, 50, 5000, 300_000)) * rng.random()) - 1 + rng.randrange(2)))
    return spark.createDataFrame(rows, names), rows


@pytest.mark.parametrize("widen", [0, 30])
def test_interval_join_is_nested_loop(spark, widen):
    left, a = random_intervals(spark, 120, 1, 1_000_000, "i long, chr string, start long, end long")
    right, b = random_intervals(spark, 120, 2, 1_000_000, "j long, r_chr string, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.interval_join(left, right, widen).select("i", "j").collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - widen <= y[3] and x[3] + widen >= y[2])
    assert got == want


def test_merge_is_idempotent_and_covers(spark):
    df, rows = random_intervals(spark, 200, 3, 2_000_000, "i long, chr string, start long, end long")
    rows = [r for r in rows if r[3] >= r[2]]
    once = intervals.merge_intervals(df.filter("end >= start"), chunk_bits=10)
    key = lambda d: sorted(map(tuple, d.select("chr", "start", "end").collect()))
    merged = key(once)
    assert key(intervals.merge_intervals(once)) == merged
    assert all(sum(c == x[1] and s <= x[2] and x[3] <= e for c, s, e in merged) == 1 for x in rows)


def test_flip_map_twice(spark):
    rows = [(1, 10, "a", 1, "r", 5, "+", "SEQ"), (2, 3, "a", 11, "r", 15, "+", "INS"), (3, 4, "a", 14, "r", 15, "-", "INV")]
    df = spark.createDataFrame(rows, "block_no int, size int, src_chr string, src_loc int, dst_chr string, dst_loc int, direction string, feature string")
    assert sorted(liftover.flip_map(liftover.flip_map(df)).collect()) == sorted(df.collect())


def greedy(edges):
    used, out = set(), set()
    for call in sorted({e[0] for e in edges}):
        taken = set()
        for piece in sorted({e[1] for e in edges if e[0] == call}):
            free = sorted(t for c, p, t in edges if c == call and p == piece and t not in used)
            if free:
                out.add((call, piece, free[0]))
                taken.add(free[0])
        used |= taken
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_is_the_ordered_loop(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(15), rng.randrange(2), rng.randrange(12)) for _ in range(60)}
    df = spark.createDataFrame([(c, c, p, t, t) for c, p, t in edges], "call int, call_order int, piece int, truth int, truth_order int")
    got = {(r.call, r.piece, r.truth) for r in match.greedy_match(df).collect()}
    assert got == greedy(edges)


def test_whole_calls_only(spark):
    edges = spark.createDataFrame([(1, 1, 0, 1, 1), (2, 2, 0, 1, 1), (2, 2, 1, 2, 2)], "call int, call_order int, piece int, truth int, truth_order int")
    need = spark.createDataFrame([(1, 2), (2, 2)], "call int, pieces int")
    got = {(r.call, r.piece, r.truth) for r in match.match_whole_calls(edges, need).collect()}
    assert got == {(2, 0, 1), (2, 1, 2)}  # call 1 lacks a piece, so call 2 finds its truth free


def test_conflicts_and_block_map(spark):
    v = spark.createDataFrame([(1, "1", 10, 5, 0, "Deletion", 2), (2, "1", 12, 1, 1, "SNP", 2), (3, "1", 30, 0, 4, "Insertion", 2), (4, "1", 30, 0, 2, "Insertion", 2), (5, "1", 99, 5, 5, "Deletion", 2)], "rec_no long, chr string, pos long, ref_len int, ins_len int, overall_type string, cn int")
    lengths = spark.createDataFrame([("1", 100)], "contig string, length long")
    kept = mapbuild.drop_conflicts(v, lengths)
    assert sorted(r.rec_no for r in kept.collect()) == [1, 3]
    blocks = [(r.feature, r["size"], r.src_loc, r.dst_loc) for r in mapbuild.build_block_map(kept, lengths).orderBy("block_no").collect()]
    assert blocks == [("SEQ", 9, 1, 1), ("DEL", 5, 9, 10), ("SEQ", 15, 10, 15), ("INS", 4, 25, 29), ("SEQ", 71, 29, 30)]


def test_vcf_scan_and_sink(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts", "1\t996\trs1\tAATG\tAC\t.\tPASS\tSVLEN=-2\tGT\t1/1", "1\t50\t.\tA\t<DEL>\t.\t.\tSVLEN=-20\tGT\t0|1", "1\t60\t.\tA\tG\t.\t.\t.\tGT\t0/0", "1\t70\t.\tA\t<FOO>\t.\t.\t.\tGT\t0/1"]
    path = tmp_path / "a.vcf"
    path.write_text("\n".join(lines) + "\n")
    good, bad = vcf.read_vcf(spark, str(path))
    rows = {r.id if r.id != "." else r.pos: r for r in good.collect()}
    a = rows["rs1"]
    assert (a.pos, a.ref, a.alts[0].seq, a.overall_type, a.ref_deleted, a.max_len) == (997, "ATG", "C", "Complex", "A", 3)
    d = rows[51]
    assert (d.ref_len, d.overall_type, d.max_len, d.gt_p, d.gt_m) == (20, "Deletion", 20, 0, 1)
    assert sorted(r.reject_reason for r in bad.collect()) == ["reference genotype", "unknown ALT"]
    vcf.write_vcf(good, str(tmp_path / "out"))
    again, _ = vcf.read_vcf(spark, str(tmp_path / "out"))
    keep = ["chr", "pos", "ref", "ref_len", "overall_type", "max_len", "gt_p", "gt_m"]
    assert sorted(map(tuple, again.select(keep).collect())) == sorted(map(tuple, good.select(keep).collect()))


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.bed").write_text("#c\nchr1\t0\t10\tn\t0\t-\n\nchr2\t5\t6\n")
    assert sorted(map(tuple, text.read_bed(spark, str(tmp_path / "r.bed")).collect())) == [("chr1", 1, 10), ("chr2", 6, 6)]
    (tmp_path / "m.map").write_text("#x\n10 a 1 r 5 + S .\n3\ta\t11\tr\t15\t+\tINS\tv1\n")
    m = text.read_map(spark, str(tmp_path / "m.map"))
    assert [(r["size"], r.feature, r.variant_id) for r in m.orderBy("block_no").collect()] == [(10, "SEQ", "."), (3, "INS", "v1")]
    sinks.write_map(m, str(tmp_path / "map"))
    assert text.read_map(spark, str(tmp_path / "map")).count() == 2
    (tmp_path / "x.rmap").write_text("r1\tchr1,1,50,+,S,0,50:chr1,60,99,+,I,50,89\tchr2,7,9,-,S,0,3\n")
    rm = text.read_read_map(spark, str(tmp_path / "x.rmap"))
    assert [(r.mate, r.block_no, r.feature) for r in rm.orderBy("mate", "block_no").collect()] == [(0, 0, "SEQ"), (0, 1, "INS"), (1, 0, "SEQ")]
    assert sinks.read_map_lines(rm).first()[0] == "r1\tchr1,1,50,+,SEQ,0,50:chr1,60,99,+,INS,50,89\tchr2,7,9,-,SEQ,0,3"
    (tmp_path / "g.fa").write_text(">c1 x\nACGTN\nACG\n>c2\nTT\n")
    fa = text.read_fasta(spark, str(tmp_path / "g.fa"), chunk=4)
    assert [(r.contig, r.start, r.bases) for r in fa.orderBy("contig", "start").collect()] == [("c1", 1, "ACGT"), ("c1", 5, "NACG"), ("c2", 1, "TT")]
    assert {r.contig: r.length for r in text.contig_lengths(fa).collect()} == {"c1": 8, "c2": 2}
    assert stats.non_n_bases(fa).first()[0] == 9
    got = intervals.region_bases(spark.createDataFrame([("c1", 3, 6)], "chr string, start long, end long"), fa)
    assert got.first().bases == "GTNA"
    (tmp_path / "a.sam").write_text("@HD\n" + "\t".join(["r1", "0", "chr1", "10", "60", "2S4M1I", "*", "0", "0", "ACGTACG", "*"]) + "\n" + "\t".join(["r2", "4", "*", "0", "0", "*", "*", "0", "0", "AC", "*"]) + "\n")
    sam = {r.read_name: r for r in text.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert sam["r1"].unclipped == 8 and abs(sam["r1"].identity - 4 / 7) < 1e-9 and sam["r2"].chr is None
    (tmp_path / "q.fq").write_text("@1-10-:1-90-:1-10-:1-90-:0:0:1:2:3:4:5:6:17:3/1\nACRT\n+\nIIII\n")
    fq = text.read_fastq(spark, str(tmp_path / "q.fq")).first()
    assert fq.bases == "ACNT" and fq.truth.loci1[0].loc == 10
    dgv = ["v1", "1", "10", "20", "CNV", "gain", "", "", "", "", "", "", "", "", "", "2", "0", "", "", ""]
    (tmp_path / "d.txt").write_text("\t".join(text.DGV_COLUMNS) + "\n" + "\t".join(dgv) + "\n")
    d = text.read_dgv(spark, str(tmp_path / "d.txt")).first()
    assert (d.allele_type, d.cn, d.alt_len) == ("Tandem_Duplication", 3, 11)


def test_sets(spark):
    a = spark.createDataFrame([(1, "1", 5, "A", "C"), (2, "1", 5, "A", "C"), (3, "2", 6, "G", "T")], "rec_no long, chr string, pos long, ref string, alt string")
    b = spark.createDataFrame([(1, "2", 6, "G", "T"), (2, "10", 1, "A", "T")], a.schema)
    ids = lambda d: sorted((r.file_no, r.rec_no) for r in d.collect())
    assert len(ids(setops.combine([a, b]))) == 5
    assert ids(setops.combine([a, b], "first")) == [(0, 1), (0, 3), (1, 2)]
    assert ids(setops.combine([a, b], "unique")) == [(1, 2)]
    assert [r.chr for r in setops.order_vcf(b).collect()] == ["2", "10"]
    assert sorted(r.number for r in setops.number_rows(a, ("pos", "rec_no")).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="not sorted"):
        setops.assert_sorted(spark.createDataFrame([(1, "1", 9), (2, "1", 3)], "rec_no long, chr string, pos long")).collect()


def test_breakends_and_lift(spark):
    dup = spark.createDataFrame([(1, "1", 5, "2", 10, 20, False, 1, 1)], "rec_no long, chr string, pos long, chr2 string, pos2 long, end2 long, is_inv boolean, gt_p int, gt_m int")
    got = canonical.dup_to_breakends(dup).orderBy("piece_no").collect()
    assert [(r.pos, r.mate_chr, r.mate_pos, r.left, r.forward, r.gt_p) for r in got] == [(4, "2", 10, True, True, 1), (5, "2", 20, False, False, 1), (4, "2", 10, True, True, 0), (5, "2", 20, False, False, 0)]
    d = spark.createDataFrame([(1, "1", 5, 3, 1, 0)], "rec_no long, chr string, pos long, ref_len int, gt_p int, gt_m int")
    assert [(r.pos, r.mate_pos) for r in canonical.del_to_breakends(d).collect()] == [(4, 8)]
    v = spark.createDataFrame([("chr1_101_200", 5, {"END": "9"})], "chr string, pos long, info map<string,string>")
    r = liftover.lift_region_variants(v).first()
    assert (r.chr, r.pos, r.info["END"]) == ("chr1", 105, "109")


def test_streaming_lift(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 100, "a", 1, "r", 501, "+", "SEQ")], "block_no int, size int, src_chr string, src_loc long, dst_chr string, dst_loc long, direction string, feature string")
    reads = spark.createDataFrame([(7, "a", 11, 61)], "rec_no long, chr string, start_pos long, end_pos long")
    reads.write.parquet(str(tmp_path / "in"))
    from verisect.streaming.lift import lift_points_stream, lift_reads_stream

    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = lift_reads_stream(stream, blocks, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(r.rec_no, r.loc) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, 511)]
    points = stream.select("rec_no", "chr", F.col("start_pos").alias("pos"))
    q = lift_points_stream(points, blocks).writeStream.format("memory").queryName("pts").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.loc for r in spark.sql("select * from pts").collect()] == [511]


def test_reports(spark, tmp_path):
    o = spark.createDataFrame([("SNP", 1, "TP"), ("SNP", 1, "FP"), ("Deletion", 200, "FN")], "overall_type string, len int, outcome string")
    sinks.write_report(stats.report_records(o, non_n=1000), {"wiggle": "20"}, str(tmp_path / "rep"))
    rec = {r.overall_type: r.record for r in text.read_reports(spark, str(tmp_path / "rep")).collect()}
    assert rec["SNP"].sum_count["_TP"] == 1 and rec["All"].sum_count["_T"] == 2
    tables = {(r.size_class, r.overall_type): r for r in cohort.summary_tables(o).collect()}
    assert tables["all", "All"].t == 2 and tables["small", "SNP"].precision == 0.5


def test_anchor_base_and_priority(spark):
    chunks = spark.createDataFrame([("1", 1, "ACGT"), ("1", 5, "TTGA")], "contig string, start long, bases string")
    v = spark.createDataFrame([(1, "1", 6)], "rec_no long, chr string, pos long")
    assert intervals.add_anchor_base(v, chunks, 4).first().anchor == "T"
    schema = "rec_no long, chr string, pos long, ref_len int, ins_len int, overall_type string, cn int"
    a = spark.createDataFrame([(9, "1", 5, 1, 1, "SNP", 2)], schema)
    b = spark.createDataFrame([(1, "1", 5, 1, 1, "SNP", 2), (2, "1", 7, 1, 1, "SNP", 2)], schema)
    assert sorted((r.file_no, r.pos) for r in mapbuild.priority_union(a, b).collect()) == [(0, 5), (1, 7)]
