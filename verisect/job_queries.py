"""Registered queries of whole jobs and of text files that span lines, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.codec_queries import _scanned
from verisect.functions import columns as C
from verisect.operators import intervals, liftover, stats
from verisect.operators.storage import new_path
from verisect.plans import jobs
from verisect.plans.projections import view
from verisect.queries import _IN, CIV, PAIRS, RATIO, TIV, WIGGLE, _assigned, _breaks, _recursive, _regions, _sql, register
from verisect.sources import sinks, text, vcf

# -- comparisons ---------------------------------------------------------------------------------------------


def _side(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Truth or calls as variant rows that went through a VCF, under their own record numbers."""
    return _scanned(spark, d, name).withColumn("rec_no", F.col("id").cast("long"))


def _edges(where: str = "true") -> str:
    """Symbolic alleles have no bases to compare; homozygous truth comes first, then the first in order."""
    small = PAIRS.replace("and t.alt=c.alt and t.overall_type=c.overall_type", "and t.overall_type=c.overall_type and (t.overall_type='Insertion' or t.len=c.len)")
    return small + f""", edges as (select distinct p.c_rec_no as call, 0 as piece, p.rec_no as truth, (case t.gt when '1|1' then 0 else 1 end)*1000000000000 + p.rec_no as best, t.len
  from pairs p join truth t using (rec_no) where {where})"""


_OUTCOME = f"""taken_ as (select * from st where taken),
judged as (
  select t.rec_no, t.overall_type, t.len, 'truth' as side, case when max(case c.gt when '1|1' then k.matched else c.len end) >= t.len*{RATIO}::double then 'TP' else 'FN' end as outcome
  from truth t left join taken_ k on k.truth=t.rec_no left join calls c on c.rec_no=k.call group by t.rec_no, t.overall_type, t.len
  union all
  select c.rec_no, c.overall_type, c.len, 'call', case when k.call is null then 'FP' else 'TP' end from calls c left join taken_ k on k.call=c.rec_no)"""


@register("compare_variants", _recursive(_sql("truth calls", "select side, rec_no, overall_type, cast(len as int) as len, outcome from judged", TIV, CIV, _edges(), _assigned(), _OUTCOME)))
def compare_variants(spark, d):
    out = jobs.compare_variants(_side(spark, d, "truth"), _side(spark, d, "calls"), ratio=RATIO, wiggle=WIGGLE)["outcomes"]
    return out.select("side", "rec_no", "overall_type", "len", "outcome")


@register("comparison_report", _recursive(_sql("truth calls", f"""select overall_type, cast(bin as int) as bin, cast(count(*) filter (outcome='TP') as bigint) as tp, cast(count(*) filter (outcome='FP') as bigint) as fp, cast(count(*) filter (outcome in ('TP','FN')) as bigint) as t,
  cast(count(*) filter (outcome in ('TP','FN') and len>=100) as bigint) as sv_t, cast(coalesce(max(t_bases), 0) as bigint) as t_bases, cast(coalesce(max(tn_bases), 0) as bigint) as tn_bases
from (select o.overall_type, b.bin, j.outcome, j.len, s.t_bases, case when o.overall_type in ('SNP','Insertion','Deletion','All') then 5000000 - s.t_bases - s.fp_bases else 0 end as tn_bases
  from (select distinct kind as overall_type from counted) o cross join (select unnest(range(0, {len(C.SIZE_BREAKS) + 1})) as bin) b
  join (select kind, sum(case when outcome in ('TP','FN') and real<>'Insertion' then len else 0 end) as t_bases, sum(case when outcome='FP' then len else 0 end) as fp_bases from counted group by kind) s on s.kind=o.overall_type
  left join counted j on j.kind=o.overall_type and j.bin=b.bin) group by overall_type, bin""", TIV, CIV, _edges(), _assigned(), _OUTCOME, f"counted as (select unnest([overall_type, 'All']) as kind, overall_type as real, outcome, len, {_breaks('len')} as bin from judged where side='truth' or outcome='FP')")))
def comparison_report(spark, d):
    """The report as it is written and read back: bins, and sums of bases with true negatives."""
    outcomes = jobs.compare_variants(_side(spark, d, "truth"), _side(spark, d, "calls"), ratio=RATIO, wiggle=WIGGLE)["outcomes"]
    path = new_path(spark)
    sinks.write_report(stats.report_records(jobs.counted_outcomes(outcomes), non_n=5_000_000), {"wiggle": WIGGLE, "overlap_percent": RATIO}, path)
    r = text.read_reports(spark, path).select("overall_type", F.posexplode(F.arrays_zip("record.bin_counts", "record.sv_bin_counts")).alias("bin", "x"), "record.sum_per_base_count")
    return r.select("overall_type", "bin", F.col("x.bin_counts._TP").alias("tp"), F.col("x.bin_counts._FP").alias("fp"), F.col("x.bin_counts._T").alias("t"), F.col("x.sv_bin_counts._T").alias("sv_t"), F.col("sum_per_base_count._T").alias("t_bases"), F.col("sum_per_base_count._TN").alias("tn_bases"))


@register("cohort_validation", _recursive(_sql("truth calls", "select 's'||cast(rec_no%4 as varchar) as sample, overall_type, cast(count(*) filter (outcome='TP') as bigint) as tp, cast(count(*) filter (outcome='FP') as bigint) as fp, cast(count(*) filter (outcome in ('TP','FN')) as bigint) as t from judged where rec_no%4<3 and (side='truth' or outcome='FP') group by 1, 2", TIV, CIV, _edges("p.rec_no%4<3 and p.c_rec_no%4=p.rec_no%4"), _assigned(), _OUTCOME)))
def cohort_validation(spark, d):
    """Four samples of truth, three of which have calls, in one comparison."""
    sampled = lambda df: df.withColumn("sample", F.concat(F.lit("s"), (F.col("rec_no") % 4).cast("string")))
    calls = sampled(_side(spark, d, "calls")).filter("sample <> 's3'")
    counts = jobs.validate_cohort(sampled(_side(spark, d, "truth")), calls, ratio=RATIO, wiggle=WIGGLE)["counts"]
    return counts.select("sample", "overall_type", "tp", "fp", "t")


@register("region_statistics", _sql("truth regions", f"select haplotype, overall_type, cast({_breaks('len')} as int) as bin, count(*) as n, cast(count(*) filter (len>=100) as bigint) as n_sv from (select t.*, unnest(case gt when '1|1' then ['paternal', 'maternal', 'overall'] else ['maternal', 'overall'] end) as haplotype from truth t where rec_no in (select t.rec_no from truth t join regions r on r.chr=t.chr and r.start_pos <= t.pos + case when overall_type='Insertion' then 0 else len-1 end and r.end_pos >= t.pos)) group by 1, 2, 3"))
def region_statistics(spark, d):
    return jobs.variant_statistics(_side(spark, d, "truth"), _regions(spark, d))


@register("augmented_without_truth", _sql("calls regions", "select k.overall_type, cast(b.bin as int) as bin, cast(0 as bigint) as tp, cast(count(i.rec_no) as bigint) as fp, cast(0 as bigint) as t from (select distinct overall_type from inside) k cross join (select unnest(range(0, 3)) as bin) b left join inside i on i.overall_type=k.overall_type and (case when i.len>5 then 1 else 0 end)+(case when i.len>50 then 1 else 0 end)=b.bin group by 1, 2", f"inside as (select * from calls t where {_IN('t.pos')} and {_IN("t.pos + case when t.overall_type='Deletion' then t.len else 1 end - 1")})"))
def augmented_without_truth(spark, d):
    """Without truth each call with both ends in a region is false; bins are the user's."""
    calls = view(spark, d, "calls").withColumns({"ref": F.lit("N"), "ref_len": F.when(F.col("overall_type") == "Deletion", F.col("len")).otherwise(1)})
    by_bin = jobs.augment_and_summarise(None, calls, None, regions=_regions(spark, d), breaks=(5, 50))["by_bin"]
    return by_bin.select("overall_type", "bin", "tp", "fp", "t")


# -- the genome ----------------------------------------------------------------------------------------------

_CHUNKS = "chunks as (select src_chr as contig, src_loc as start, substr(repeat(case when feature='INS' then 'NnN' when feature='INV' then 'ANNcgt' else 'ACGTN' end, cast(size as int)), 1, cast(size as int)) as bases from map_blocks where feature<>'DEL')"
_MASK = "mask as (select chr, start_pos%50000+1 as s, start_pos%50000+1+rec%300 as e from (select *, end_pos*7 as rec from regions))"
_BASES = "bases_ as materialized (select contig, start+i as p, substr(bases, cast(i as int)+1, 1) as b from (select *, unnest(range(0, length(bases))) as i from chunks))"
_COVER = "cover as materialized (select distinct chr, unnest(range(s, e+1)) as p from mask)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("feature") == "INS", "NnN").when(F.col("feature") == "INV", "ANNcgt").otherwise("ACGTN")
    rows = view(spark, d, "map_blocks").filter("feature <> 'DEL'")
    return rows.select(F.col("src_chr").alias("contig"), F.col("src_loc").alias("start"), F.substr(F.repeat(unit, F.col("size").cast("int")), F.lit(1), F.col("size").cast("int")).alias("bases"))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("start") % 50000 + 1
    return _regions(spark, d).select("chr", start.alias("start"), (start + (F.col("end") * 7) % 300).alias("end"))


@register("region_non_n", _sql("map_blocks regions", "select cast(count(*) as bigint) as non_n from bases_ b join cover c on c.chr=b.contig and c.p=b.p where upper(b.b)<>'N'", _CHUNKS, _MASK, _BASES, _COVER))
def region_non_n(spark, d):
    return stats.non_n_bases(_chunks(spark, d), _mask(spark, d))


@register("subtract_regions", _sql("map_blocks regions", "select contig as chr, cast(count(*) as bigint) as n, cast(sum(b.p) as bigint) as places from bases_ b where upper(b.b)<>'N' and not exists (select 1 from cover c where c.chr=b.contig and c.p=b.p) group by contig", _CHUNKS, _MASK, _BASES, _COVER))
def subtract_regions(spark, d):
    """What the runs of known bases hold outside the regions: bases and the sum of their places."""
    left = intervals.subtract_intervals(stats.base_runs(_chunks(spark, d)), _mask(spark, d))
    n = F.col("end") - F.col("start") + 1
    return left.groupBy("chr").agg(F.sum(n).alias("n"), F.sum(F.expr("(end - start + 1) * (start + end) div 2")).alias("places"))


@register("fasta_round_trip", _sql("map_blocks", "select contig, cast(i as bigint) as chunk_no, i*1000+1 as start, substr(whole, cast(i*1000+1 as int), 1000) as bases from (select *, unnest(range(0, (length(whole)+999)//1000)) as i from (select contig, string_agg(bases, '' order by start) as whole from chunks group by contig))", _CHUNKS))
def fasta_round_trip(spark, d):
    """A file for each of several groups of contigs, whose lines are blocks of the map, read in small parts."""
    rows = _chunks(spark, d)
    heads = rows.select("contig").distinct().select("contig", F.lit(0).cast("long").alias("start"), F.concat(F.lit(">"), "contig", F.lit(" made up")).alias("value"))
    path = new_path(spark)
    heads.unionByName(rows.select("contig", "start", F.col("bases").alias("value"))).repartition(3, "contig").sortWithinPartitions("contig", "start").select("value").write.text(path)
    return text.read_fasta(spark, path, chunk=1000)


@register("fastq_round_trip", _sql("truth", "select 'r'||cast(rec_no as varchar) as name, alt||'ACNT' as bases, cast(count(*) as bigint) as n from truth group by 1, 2"))
def fastq_round_trip(spark, d):
    lines = F.array(F.concat(F.lit("@r"), F.col("rec_no").cast("string")), F.concat("alt", F.lit("ACRT")), F.lit("+"), F.lit("IIIII"))
    path = new_path(spark)
    view(spark, d, "truth").repartition(3).select(F.explode(lines).alias("value")).write.option("compression", "gzip").text(path)
    return text.read_fastq(spark, path).groupBy("name", "bases").agg(F.count("*").alias("n"))


# -- fields, reads and maps ----------------------------------------------------------------------------------


@register("value_histogram", _sql("truth", "select cast(case when hi > lo then least(floor((len - lo) * k / (hi - lo)), k - 1) else 0 end as int) as bin, count(*) as n from truth cross join (select min(len) as lo, max(len) as hi, least(10, count(*)) as k from truth) group by 1"))
def value_histogram(spark, d):
    return stats.histogram(view(spark, d, "truth"), "len", 10)


@register("region_map", _sql("map_blocks", "select block_no, 'ref'||cast(block_no % 5 as varchar) as dst_chr, cast(dst_loc + block_no + 100 as bigint) as dst_loc, src_chr, src_loc from map_blocks where block_no % 3 > 0"))
def region_map(spark, d):
    """Blocks whose destination is named by a region of a contig; those of whole contigs are dropped."""
    contig, first = F.concat(F.lit("ref"), (F.col("block_no") % 5).cast("string")), F.col("block_no") + 101
    named = F.concat_ws("_", contig, first.cast("string"), (first + 9999).cast("string"))
    blocks = view(spark, d, "map_blocks").withColumn("dst_chr", F.when(F.col("block_no") % 3 > 0, named).otherwise(contig))
    return liftover.lift_region_map(blocks).select("block_no", "dst_chr", F.col("dst_loc").cast("long").alias("dst_loc"), "src_chr", "src_loc")


@register("picked_samples", _sql("truth", "select rec_no, cast(len as varchar) as dp, 'q'||cast(rec_no % 5 as varchar) as only_info, case when rec_no % 2 = 0 then '1|0' else '0|1' end||':'||cast(len as varchar) as sample from truth"))
def picked_samples(spark, d):
    """The second of two samples of each line, and its fields by name: FORMAT comes before INFO."""
    size, other = F.col("len").cast("string"), F.concat(F.lit("DP=77;Q=q"), (F.col("rec_no") % 5).cast("string"))
    second = F.concat(F.when(F.col("rec_no") % 2 == 0, "1|0:").otherwise("0|1:"), size)
    line = F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.col("rec_no").cast("string"), F.lit("N"), F.lit("A"), F.lit("."), F.lit("."), other, F.lit("GT:DP"), F.lit("1|1:5"), second)
    path = new_path(spark)
    view(spark, d, "truth").select(line.alias("value")).write.text(path)
    rows = vcf.parse_lines(vcf.select_samples(text.read_lines(spark, path), [1]))
    return rows.select(F.col("id").cast("long").alias("rec_no"), vcf.get_field("DP").alias("dp"), vcf.get_field("Q").alias("only_info"), "sample")


@register("reads_from_bed", _sql("truth", "select 'r'||cast(rec_no as varchar) as read_name, chr, cast(pos as bigint) as start, cast(pos + len as bigint) as end_pos, case when rec_no % 2 = 0 then '+' else '-' end as strand, cast(len as bigint) as read_end from truth"))
def reads_from_bed(spark, d):
    strand = F.when(F.col("rec_no") % 2 == 0, "+").otherwise("-")
    line = F.concat_ws("\t", "chr", F.col("pos").cast("string"), (F.col("pos") + F.col("len")).cast("string"), F.concat(F.lit("r"), F.col("rec_no").cast("string")), F.lit("0"), strand)
    path = new_path(spark)
    view(spark, d, "truth").select(line.alias("value")).write.text(path)
    reads = text.read_map_from_bed(spark, path)
    return reads.select("read_name", "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_pos"), "strand", F.col("read_end").cast("long").alias("read_end"))


@register("breakends_alike", _sql("truth", "select rec_no, chr='chr1' and rec_no % 2 = 0 and abs(pos - 5000) <= 4000 as alike from truth"))
def breakends_alike(spark, d):
    end = lambda chr_, pos, left: F.struct(chr_.alias("chr"), pos.alias("pos"), left.alias("left"), F.lit(True).alias("forward"))
    mine, fixed = end(F.col("chr"), F.col("pos"), F.col("rec_no") % 2 == 0), end(F.lit("chr1"), F.lit(5000), F.lit(True))
    return view(spark, d, "truth").select("rec_no", C.breakend_like(mine, fixed, 4000).alias("alike"))
