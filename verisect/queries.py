"""Registered queries over the projected tables, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators import alignments, canonical, cohort, intervals, liftover, mapbuild, match, setops, stats
from verisect.operators.storage import stored
from verisect.plans.projections import view, with_views

RATIO, WIGGLE = 0.8, 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# -- shared SQL ----------------------------------------------------------------------------------------------


def _iv(p: str = "") -> str:
    """Start and end of a variant, as F8 defines them."""
    half = f"{p}len/2.0"
    return f"case when {p}overall_type='Insertion' then cast(trunc({p}pos-{half}) as bigint) else {p}pos end as s, case when {p}overall_type='Insertion' then cast(trunc({p}pos+{half}-1) as bigint) else {p}pos+{p}len-1 end as e"


TIV = f"tiv as (select *, {_iv()} from truth)"
CIV = f"civ as (select *, {_iv()} from calls)"


def _overlap(a: str, b: str, wiggle: int = WIGGLE, ratio: float = RATIO) -> str:
    shift = f"greatest(-{wiggle}, least({wiggle}, {b}.s-{a}.s))"
    return f"least({a}.e+{shift}, {b}.e) - greatest({a}.s+{shift}, {b}.s) + 1 >= greatest({a}.e-{a}.s+1, {b}.e-{b}.s+1) * {ratio}::double"


#: Pairs of truth and call that may match, and what was matched at least once. Lengths are 400 at most, so wide
#: pairs lie in the same or neighbouring cells of 4096 bases, which lets the other engine join by equality.
PAIRS = f"""pairs as materialized (
  select t.rec_no, c.rec_no as c_rec_no, t.overall_type, t.len, c.len as c_len, t.pos, c.pos as c_pos from tiv t join civ c on t.chr=c.chr and t.pos=c.pos and t.alt=c.alt where t.overall_type='SNP' and c.overall_type='SNP'
  union all
  select t.rec_no, c.rec_no, t.overall_type, t.len, c.len, t.pos, c.pos from tiv t join civ c on t.chr=c.chr and t.pos=c.pos and t.alt=c.alt and t.overall_type=c.overall_type
  where t.overall_type in ('Insertion','Deletion') and t.len<100 and c.len<100 and {_overlap("t", "c", 0)}
  union all
  select t.rec_no, c.rec_no, t.overall_type, t.len, c.len, t.pos, c.pos from (select *, pos//4096 + unnest([-1, 0, 1]) as cell from tiv) t join civ c on t.chr=c.chr and t.overall_type=c.overall_type and t.cell=c.pos//4096 and c.s <= t.e+{WIGGLE} and c.e >= t.s-{WIGGLE}
  where t.overall_type<>'SNP' and not (t.overall_type in ('Insertion','Deletion') and t.len<100) and not (c.overall_type in ('Insertion','Deletion') and c.len<100) and {_overlap("c", "t")})"""
OUTCOMES = """outcomes as (
  select t.rec_no, t.overall_type, t.len, case when exists (select 1 from pairs p where p.rec_no=t.rec_no) then 'TP' else 'FN' end as outcome from truth t
  union all
  select c.rec_no, c.overall_type, c.len, 'FP' from calls c where not exists (select 1 from pairs p where p.c_rec_no=c.rec_no))"""


def _breaks(x: str) -> str:
    return "(" + " + ".join(f"(case when {x}>{b} then 1 else 0 end)" for b in C.SIZE_BREAKS) + ")"


def _label(n: str) -> str:
    lows, highs = [1, *(b + 1 for b in C.SIZE_BREAKS)], [*C.SIZE_BREAKS, "inf"]
    return f"case {n} " + " ".join(f"when {i} then '[{lo},{hi}]'" for i, (lo, hi) in enumerate(zip(lows, highs, strict=True))) + " end"


def _sql(views: str, tail: str, *ctes: str) -> str:
    """The views' CTEs, more CTEs, then a select."""
    names = tuple(views.split())
    more = "".join(f",\n{c}" for c in ctes)
    return with_views(names, "").rstrip() + more + "\n" + tail


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- shared frames -------------------------------------------------------------------------------------------


def spans(df: DataFrame) -> DataFrame:
    start, end = C.interval_ends(F.col("overall_type"), F.col("pos"), F.col("len"))
    return df.withColumns({"start": start, "end": end})


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return spans(view(spark, d, "truth"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return spans(view(spark, d, "calls"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "regions").select("chr", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return match.candidates(_truth(spark, d), prefixed(_calls(spark, d), "c_"), RATIO, WIGGLE)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    truth, calls = view(spark, d, "truth"), view(spark, d, "calls")
    pairs = stored(_pairs(spark, d).select("rec_no", "c_rec_no"))  # both sides of the outcome need them
    seen = pairs.select("rec_no").distinct().withColumn("__hit", F.lit(True))
    t = truth.join(seen, "rec_no", "left").select("rec_no", "overall_type", "len", F.when(F.col("__hit"), "TP").otherwise("FN").alias("outcome"))
    false = calls.join(pairs.select(F.col("c_rec_no").alias("rec_no")).distinct(), "rec_no", "left_anti")
    return t.unionByName(false.select("rec_no", "overall_type", "len", F.lit("FP").alias("outcome")))


# -- joins ---------------------------------------------------------------------------------------------------


@register("interval_overlap", _sql("truth regions", "select t.rec_no, r.start_pos as region_start from tiv t join regions r on t.chr=r.chr and t.s<=r.end_pos and t.e>=r.start_pos", TIV))
def interval_overlap(spark, d):
    r = _regions(spark, d)
    pairs = intervals.interval_join(_truth(spark, d).select("rec_no", "chr", "start", "end"), prefixed(r, "r_"))
    return pairs.select("rec_no", F.col("r_start").alias("region_start"))


@register("reciprocal_overlap_wiggle", _sql("truth calls", f"select t.rec_no, c.rec_no as c_rec_no from tiv t join civ c on t.chr=c.chr and t.overall_type=c.overall_type and c.s<=t.e+{WIGGLE} and c.e>=t.s-{WIGGLE} where t.overall_type<>'SNP' and {_overlap('t', 'c')}", TIV, CIV))
def reciprocal_overlap_wiggle(spark, d):
    t = _truth(spark, d).filter("overall_type <> 'SNP'").select("rec_no", "chr", "start", "end", "overall_type")
    c = prefixed(_calls(spark, d).filter("overall_type <> 'SNP'").select("rec_no", "chr", "start", "end", "overall_type"), "c_")
    pairs = intervals.overlap_join(t, c, RATIO, WIGGLE, (("overall_type", "c_overall_type"),), right_cols=("c_chr", "c_start", "c_end"))
    return pairs.select("rec_no", "c_rec_no")


@register("snp_match", _sql("truth calls", "select t.rec_no, c.rec_no as c_rec_no from truth t join calls c on t.chr=c.chr and t.pos=c.pos and t.alt=c.alt where t.overall_type='SNP' and c.overall_type='SNP'"))
def snp_match(spark, d):
    snp = "overall_type = 'SNP'"
    return match.snp_join(view(spark, d, "truth").filter(snp), prefixed(view(spark, d, "calls").filter(snp), "c_")).select("rec_no", "c_rec_no")


@register("small_exact_match", _sql("truth calls", f"select t.rec_no, c.rec_no as c_rec_no from tiv t join civ c on t.chr=c.chr and t.pos=c.pos and t.alt=c.alt and t.overall_type=c.overall_type where t.overall_type in ('Insertion','Deletion') and t.len<100 and c.len<100 and {_overlap('t', 'c', 0)}", TIV, CIV))
def small_exact_match(spark, d):
    small = C.is_small(F.col("overall_type"), F.col("len"))
    return match.small_join(_truth(spark, d).filter(small), prefixed(_calls(spark, d).filter(small), "c_"), RATIO).select("rec_no", "c_rec_no")


_BND = "select rec_no, chr, pos, 'chr'||cast(1+cast(substr(chr,4) as int)%5 as varchar) as mate_chr, pos+len as mate_pos, gt='1|1' as l, rec_no%2=0 as fwd"


@register("breakend_match", _sql("truth calls", f"select t.rec_no, c.rec_no as c_rec_no from tb t join cb c on t.chr=c.chr and t.mate_chr=c.mate_chr and t.l=c.l and t.fwd=c.fwd where abs(t.pos-c.pos)<={WIGGLE} and abs(t.mate_pos-c.mate_pos)<={WIGGLE}", f"tb as ({_BND} from truth where overall_type='TandemDup')", f"cb as ({_BND} from calls where overall_type='TandemDup')"))
def breakend_match(spark, d):
    def ends(name: str) -> DataFrame:
        mate = F.concat(F.lit("chr"), (1 + F.substring("chr", 4, 9).cast("int") % 5).cast("string"))
        return view(spark, d, name).filter("overall_type = 'TandemDup'").select("rec_no", "chr", "pos", mate.alias("mate_chr"), (F.col("pos") + F.col("len")).alias("mate_pos"), (F.col("gt") == "1|1").alias("left"), (F.col("rec_no") % 2 == 0).alias("forward"))

    return intervals.breakend_join(ends("truth"), prefixed(ends("calls"), "r_"), WIGGLE).select("rec_no", F.col("r_rec_no").alias("c_rec_no"))


@register("regions_semi", _sql("truth regions", "select t.rec_no from tiv t where exists (select 1 from regions r where t.chr=r.chr and t.s<=r.end_pos and t.e>=r.start_pos)", TIV))
def regions_semi(spark, d):
    return intervals.in_regions(_truth(spark, d), _regions(spark, d), ("rec_no",)).select("rec_no")


_IN = lambda x: f"exists (select 1 from regions r where t.chr=r.chr and {x}<=r.end_pos and {x}>=r.start_pos)"


@register("endpoints_both", _sql("truth regions", f"select t.rec_no from tiv t where {_IN('t.s')} and {_IN('t.e')}", TIV))
def endpoints_both(spark, d):
    return intervals.endpoints_in_regions(_truth(spark, d), _regions(spark, d)).select("rec_no")


@register("endpoints_either", _sql("truth regions", f"select t.rec_no from tiv t where {_IN('t.s')} or {_IN('t.e')}", TIV))
def endpoints_either(spark, d):
    return intervals.endpoints_in_regions(_truth(spark, d), _regions(spark, d), either=True).select("rec_no")


@register("nearest_call", _sql("truth calls", "select rec_no, c_rec_no, distance from (select t.rec_no, c.rec_no as c_rec_no, abs(t.pos-c.pos) as distance, row_number() over (partition by t.rec_no order by abs(t.pos-c.pos), c.rec_no) as rn from truth t join calls c on t.chr=c.chr and c.pos between t.pos-99 and t.pos+99) where rn=1"))
def nearest_call(spark, d):
    near = intervals.nearest_join(view(spark, d, "truth").select("rec_no", "chr", "pos"), prefixed(view(spark, d, "calls").select("rec_no", "chr", "pos"), "r_"))
    return near.select("rec_no", F.col("r_rec_no").alias("c_rec_no"), "distance")


@register("allele_match_first", _sql("truth calls", "select t.rec_no, min(c.rec_no) as c_rec_no from truth t join calls c on t.chr=c.chr and t.pos=c.pos and t.overall_type=c.overall_type and t.alt=c.alt group by t.rec_no"))
def allele_match_first(spark, d):
    keys = ("chr", "pos", "overall_type", "alt")
    return intervals.allele_join(view(spark, d, "truth"), prefixed(view(spark, d, "calls").select("rec_no", *keys), "r_"), keys).select("rec_no", F.col("r_rec_no").alias("c_rec_no"))


@register("interval_merge", _sql("truth", "select chr, min(s) as start_pos, max(e) as end_pos from (select *, sum(new) over (partition by chr order by s, e, rec_no rows unbounded preceding) as island from (select *, case when s <= 1 + max(e) over (partition by chr order by s, e, rec_no rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from tiv)) group by chr, island", TIV))
def interval_merge(spark, d):
    return intervals.merge_intervals(_truth(spark, d)).select("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


# -- lifting -------------------------------------------------------------------------------------------------

_NEXT = "nxt as (select src_chr, src_loc, lead(src_loc) over (partition by src_chr order by src_loc) as next_loc from (select distinct src_chr, src_loc from map_blocks))"
ASOF = "touched as (select l.rec_no, l.start_pos, l.end_pos, b.* from to_lift l join map_blocks b on l.chr=b.src_chr join nxt n on n.src_chr=b.src_chr and n.src_loc=b.src_loc where b.src_loc<=l.end_pos-1 and coalesce(n.next_loc, 1000000000000)>l.start_pos)"


@register("asof_block", _sql("to_lift map_blocks", "select rec_no, block_no from touched", _NEXT, ASOF))
def asof_block(spark, d):
    return liftover.asof_block(view(spark, d, "to_lift"), view(spark, d, "map_blocks")).select("rec_no", F.col("b_block_no").alias("block_no"))


LIFTED = """hit as (
  select l.rec_no, b.*, greatest(l.start_pos+1, b.src_loc) as f, least(l.end_pos, b.src_loc + (case when b.feature='DEL' then 0 else b.size end) - 1) as t
  from to_lift l join map_blocks b on l.chr=b.src_chr and l.start_pos+1<=b.src_loc+b.size-1 and l.end_pos>=b.src_loc
), sized as (
  select *, greatest(t-f+1, 0) as read_len, dst_loc+f-src_loc as lo from hit
), ended as (
  select *, case when feature='DEL' then lo-1+size when feature='INS' then lo-1 else least(lo+read_len-1, dst_loc+size-1) end - lo + 1 as piece_len,
    coalesce(sum(read_len) over (partition by rec_no order by src_loc, block_no rows between unbounded preceding and 1 preceding), 0) + 1 as read_offset from sized
), pieces as (
  select rec_no, block_no, dst_chr as piece_chr, (case when direction='+' then dst_loc+f-src_loc else dst_loc+src_loc+size-1-t end) - 1 as piece_start, piece_len,
    case when direction='+' then '+' else '-' end as piece_strand, feature, cast(read_offset as bigint) as read_offset, cast(read_len as bigint) as read_len
  from ended where piece_len >= 1)"""


@register("lift_intervals", _sql("to_lift map_blocks", "select rec_no, block_no, piece_chr, cast(piece_start as bigint) as piece_start, cast(piece_start+piece_len as bigint) as piece_end, piece_strand, feature from pieces", LIFTED))
def lift_intervals(spark, d):
    return liftover.lift_intervals(view(spark, d, "to_lift"), view(spark, d, "map_blocks")).select("rec_no", "block_no", "piece_chr", F.col("piece_start").cast("long").alias("piece_start"), F.col("piece_end").cast("long").alias("piece_end"), "piece_strand", "feature")


@register("read_offsets", _sql("to_lift map_blocks", "select rec_no, block_no, read_offset, read_len from pieces", LIFTED))
def read_offsets(spark, d):
    return liftover.lift_intervals(view(spark, d, "to_lift"), view(spark, d, "map_blocks")).select("rec_no", "block_no", F.col("read_offset").cast("long").alias("read_offset"), F.col("read_len").cast("long").alias("read_len"))


@register("lift_merge", _sql("to_lift map_blocks", "select rec_no, piece_chr, cast(min(piece_start) as bigint) as piece_start, cast(max(piece_end) as bigint) as piece_end from (select *, sum(new) over (partition by rec_no, piece_chr order by piece_start, piece_end, block_no rows unbounded preceding) as island from (select *, piece_start+piece_len as piece_end, case when piece_start <= max(piece_start+piece_len) over (partition by rec_no, piece_chr order by piece_start, piece_start+piece_len, block_no rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from pieces)) group by rec_no, piece_chr, island", LIFTED))
def lift_merge(spark, d):
    merged = liftover.lift_merge(liftover.lift_intervals(view(spark, d, "to_lift"), view(spark, d, "map_blocks")))
    return merged.withColumns({c: F.col(c).cast("long") for c in ("piece_start", "piece_end")})


@register("first_indel_per_read", _sql("to_lift map_blocks", "select rec_no, block_no from (select *, row_number() over (partition by rec_no, feature order by src_loc, block_no) as rn from touched) where feature not in ('INS','DEL') or rn=1", _NEXT, ASOF))
def first_indel_per_read(spark, d):
    return liftover.first_indel_per_read(liftover.asof_block(view(spark, d, "to_lift"), view(spark, d, "map_blocks"))).select("rec_no", F.col("b_block_no").alias("block_no"))


@register("lift_reads", _sql("to_lift map_blocks", "select rec_no, block_no, dst_chr as loc_chr, cast(case when feature in ('INS','DEL') then dst_loc when direction='+' then dst_loc+start_pos-src_loc else dst_loc+size-(end_pos-(src_loc+1)) end as bigint) as loc, feature, case when feature in ('INS','DEL') or direction='+' then '+' else '-' end as direction from (select *, row_number() over (partition by rec_no, feature order by src_loc, block_no) as rn from touched) where (feature in ('INS','DEL') and rn=1) or (feature not in ('INS','DEL') and least(end_pos-1, src_loc+size-1)-greatest(start_pos, src_loc)+1 >= 10)", _NEXT, ASOF))
def lift_reads(spark, d):
    loci = liftover.lift_loci(view(spark, d, "to_lift"), view(spark, d, "map_blocks"))
    return loci.withColumn("loc", F.col("loc").cast("long"))


@register("flip_map", _sql("map_blocks", "select block_no, size, dst_chr as src_chr, cast(dst_loc as bigint) as src_loc, src_chr as dst_chr, cast(src_loc as bigint) as dst_loc, direction, case feature when 'INS' then 'DEL' when 'DEL' then 'INS' else feature end as feature from map_blocks"))
def flip_map(spark, d):
    return liftover.flip_map(view(spark, d, "map_blocks")).withColumns({c: F.col(c).cast("long") for c in ("src_loc", "dst_loc")})


@register("map_coordinates", _sql("map_blocks", "select block_no, src_chr, cast(src_loc as bigint) as src_loc, cast(dst_loc as bigint) as dst_loc from map_blocks"))
def map_coordinates(spark, d):
    return liftover.assign_coordinates(view(spark, d, "blk")).select("block_no", "src_chr", F.col("src_loc").cast("long").alias("src_loc"), F.col("dst_loc").cast("long").alias("dst_loc"))


# -- counts --------------------------------------------------------------------------------------------------

_COUNT = "cast(sum(case when outcome='TP' then 1 else 0 end) as bigint) as tp, cast(sum(case when outcome='FP' then 1 else 0 end) as bigint) as fp, cast(sum(case when outcome in ('TP','FN') then 1 else 0 end) as bigint) as t"
_ALL = (TIV, CIV, PAIRS, OUTCOMES)


@register("confusion_by_type", _sql("truth calls", f"select coalesce(overall_type, 'All') as overall_type, {_COUNT} from outcomes group by rollup(overall_type)", *_ALL))
def confusion_by_type(spark, d):
    return stats.confusion_by_type(_outcomes(spark, d))


def _bins_sql(where: str) -> str:
    grid = f"grid as (select * from (select distinct overall_type from outcomes) cross join (select unnest(range(0, {len(C.SIZE_BREAKS) + 1})) as bin))"
    cnt = f"cnt as (select overall_type, {_breaks('len')} as bin, {_COUNT} from outcomes where {where} group by 1, 2)"
    return _sql("truth calls", f"select g.overall_type, cast(g.bin as int) as bin, coalesce(tp,0) as tp, coalesce(fp,0) as fp, coalesce(t,0) as t, {_label('g.bin')} as bin_range from grid g left join cnt c on g.overall_type=c.overall_type and g.bin=c.bin", *_ALL, grid, cnt)


@register("confusion_by_bin", _bins_sql("true"))
def confusion_by_bin(spark, d):
    return stats.confusion_by_bin(_outcomes(spark, d))


@register("sv_bins", _bins_sql(f"len>={C.SV_LENGTH}"))
def sv_bins(spark, d):
    return stats.confusion_by_bin(_outcomes(spark, d), sv_length=C.SV_LENGTH)


@register("per_base_and_tn", _sql("truth calls", "select overall_type, tp_bases, fp_bases, t_bases, 1000000 - t_bases - fp_bases as tn_bases from (select overall_type, cast(sum(case when outcome='TP' then len else 0 end) as bigint) as tp_bases, cast(sum(case when outcome='FP' then len else 0 end) as bigint) as fp_bases, cast(sum(case when outcome in ('TP','FN') and overall_type<>'Insertion' then len else 0 end) as bigint) as t_bases from outcomes group by overall_type)", *_ALL))
def per_base_and_tn(spark, d):
    return stats.true_negatives(stats.per_base(_outcomes(spark, d)), 1_000_000)


@register("metrics", _sql("truth calls", "select overall_type, tp, fp, t, round(case when t<>0 then tp::double/t end, 6) as tpr, round(case when fp+tp<>0 then fp::double/(fp+tp) end, 6) as fdr, round(case when fp+tp<>0 then tp::double/(fp+tp) end, 6) as ppv, round(case when fp<>0 then 0.0::double/fp end, 6) as spc, round(case when t<>0 and fp+tp<>0 and (1-fp::double/(fp+tp)+tp::double/t)<>0 then 2*(1-fp::double/(fp+tp))*(tp::double/t)/(1-fp::double/(fp+tp)+tp::double/t) end, 6) as f1 from (" + f"select coalesce(overall_type, 'All') as overall_type, {_COUNT} from outcomes group by rollup(overall_type))", *_ALL))
def metrics(spark, d):
    return stats.with_metrics(stats.confusion_by_type(_outcomes(spark, d)), places=6)


@register("summary_tables", _sql("truth calls", f"select coalesce(size_class,'all') as size_class, coalesce(overall_type,'All') as overall_type, tp, fp, t, round(case when t<>0 then tp::double/t end,6) as recall, round(case when tp+fp<>0 then tp::double/(tp+fp) end,6) as prec from (select size_class, overall_type, {_COUNT} from (select *, case when len>={C.SV_LENGTH} then 'sv' else 'small' end as size_class from outcomes) group by cube(size_class, overall_type))", *_ALL))
def summary_tables(spark, d):
    table = cohort.summary_tables(_outcomes(spark, d))
    return table.select("size_class", "overall_type", "tp", "fp", "t", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("prec"))


def _gt(x: str) -> Column:
    return F.split(x, r"\|")


def _alleles(df: DataFrame) -> DataFrame:
    return df.withColumns({"gt_p": _gt("gt")[0].cast("int"), "gt_m": _gt("gt")[1].cast("int")})


_HAP = "select 'paternal' as haplotype, * from truth where gt='1|1' union all select 'maternal', * from truth union all select 'overall', * from truth"


@register("variant_stats", _sql("truth", f"select haplotype, overall_type, cast({_breaks('len')} as int) as bin, count(*) as n, cast(sum(case when len>=100 then 1 else 0 end) as bigint) as n_sv from ({_HAP}) group by 1, 2, 3"))
def variant_stats(spark, d):
    return stats.variant_stats(_alleles(view(spark, d, "truth")))


@register("count_by_allele_type", _sql("truth", "select overall_type, cast(sum(case when gt='1|1' then 1 else 2 end) as bigint) as n from (select *, lag(pos) over w as p, lag(overall_type) over w as o, lag(len) over w as l, lag(alt) over w as a from truth window w as (partition by chr order by rec_no)) where not coalesce(p=pos and o=overall_type and l=len and a=alt, false) and len between 1 and 200 group by overall_type"))
def count_by_allele_type(spark, d):
    return stats.count_by_allele_type(_alleles(view(spark, d, "truth")), 1, 200)


@register("adjacent_dedupe", _sql("truth", "select rec_no from (select *, lag(overall_type) over (partition by chr order by rec_no) as o, lag(alt) over (partition by chr order by rec_no) as a from truth) where not coalesce(o=overall_type and a=alt, false)"))
def adjacent_dedupe(spark, d):
    return stats.drop_adjacent_dups(view(spark, d, "truth"), ("overall_type", "alt")).select("rec_no")


@register("vcf_totals", _sql("truth", "select cast(rec_no%4 as int) as file_no, count(*) as n, cast(sum(len) as bigint) as bases from truth group by 1"))
def vcf_totals(spark, d):
    rows = view(spark, d, "truth").select((F.col("rec_no") % 4).cast("int").alias("file_no"), F.col("len").alias("bases"))
    return stats.vcf_totals(rows)


# -- alignments ----------------------------------------------------------------------------------------------

_STATUS = "status as (select read_name, feature, case when chr is null then 255 else mapq end as mapq, case when chr is null then case when feature in ('Insertion','Deletion') then 'TN' else 'FN' end when feature in ('Insertion','Deletion') then 'TP' when not (chr=true_chr and abs(pos-true_pos)<=20) and identity<=1.0 and mapq>10 then 'FP' else 'TP' end as status, chr is not null and feature in ('Insertion','Deletion') and identity<=1.0 and mapq>10 as tum from alignments where flags&2304=0)"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "alignments")
    block = F.when(F.col("feature") == "Insertion", "INS").when(F.col("feature") == "Deletion", "DEL").when(F.col("feature") == "TandemDup", "DUP_TANDEM").otherwise("SEQ")
    loci = F.array(F.struct(F.col("true_chr").alias("chr"), F.col("true_pos").alias("loc"), block.alias("feature")))
    return alignments.classify_alignments(a.filter(alignments.primary_only(F.col("flags"))).withColumn("loci", loci))


@register("classify_alignments", _sql("alignments", "select read_name, cast(mapq as int) as mapq, status, tum from status", _STATUS))
def classify_alignments(spark, d):
    return _classified(spark, d).select("read_name", "mapq", "status", F.coalesce("tum", F.lit(False)).alias("tum"))


_LADDER = "cast(sum(case when status='TP' then 1 else 0 end) as bigint) as tp, cast(sum(case when status='FP' then 1 else 0 end) as bigint) as fp, cast(sum(case when status='TN' then 1 else 0 end) as bigint) as tn, cast(sum(case when status='FN' then 1 else 0 end) as bigint) as fn"


@register("mapq_ladder", _sql("alignments", f"select cast(c as int) as cutoff, {_LADDER} from (select unnest(range(0, 256)) as c) g join status s on s.mapq>=g.c group by c", _STATUS))
def mapq_ladder(spark, d):
    return stats.confusion_by_mapq(_classified(spark, d))


_EVENTS = "ev as (select 'All' as event, mapq, status from status union all select case feature when 'Insertion' then 'INS' when 'Deletion' then 'DEL' when 'TandemDup' then 'DUP_TANDEM' else 'SEQ' end, mapq, status from status union all select 'True_Unmapped', mapq, status from status where feature in ('Insertion','Deletion'))"


@register("event_ladder", _sql("alignments", f"select e.event, cast(c as int) as cutoff, {_LADDER}, max(n.t) as t from (select unnest(range(0, 256)) as c) g join ev e on e.mapq>=g.c join (select event, count(*) as t from ev group by event) n on n.event=e.event group by e.event, c", _STATUS, _EVENTS))
def event_ladder(spark, d):
    named = _classified(spark, d).withColumn("features", alignments.events_of(F.col("loci")))
    return stats.confusion_by_event(named).select("event", "cutoff", "tp", "fp", "tn", "fn", "t")


# -- outcomes ------------------------------------------------------------------------------------------------


@register("truth_outcome", _sql("truth calls", f"select t.rec_no, cast(coalesce(v,0) as bigint) as validated, case when coalesce(v,0)>0 and v>=t.len*{RATIO}::double then 'TP' else 'FN' end as outcome from truth t left join (select rec_no, max(least(len, c_len)) as v from pairs group by rec_no) p on p.rec_no=t.rec_no", TIV, CIV, PAIRS))
def truth_outcome(spark, d):
    v = _pairs(spark, d).groupBy("rec_no").agg(F.max(F.least("len", "c_len")).cast("long").alias("validated"))
    return match.truth_outcome(view(spark, d, "truth"), v, RATIO).select("rec_no", F.col("validated").cast("long").alias("validated"), "outcome")


@register("call_outcome", _sql("truth calls", f"select c.rec_no, cast(coalesce(v,0) as bigint) as validated, case when coalesce(v,0)=0 or v<c.len*{RATIO}::double then 'FP' else 'TP' end as outcome from calls c left join (select c_rec_no, max(least(len, c_len)) as v from pairs group by c_rec_no) p on p.c_rec_no=c.rec_no", TIV, CIV, PAIRS))
def call_outcome(spark, d):
    v = _pairs(spark, d).groupBy(F.col("c_rec_no").alias("rec_no")).agg(F.max(F.least("len", "c_len")).cast("long").alias("validated"))
    return match.call_outcome(view(spark, d, "calls"), v, RATIO).select("rec_no", F.col("validated").cast("long").alias("validated"), "outcome")


@register("validated_lengths", _sql("truth calls", "select rec_no, cast(sum(len) as bigint) as validated, max(abs(c_pos-pos)) as d_start, max(abs(c_pos-pos + case when overall_type in ('Insertion','SNP','TandemDup') then 0 else c_len-len end)) as d_end, cast(max(abs(c_len-len)) as bigint) as d_len from pairs group by rec_no", TIV, CIV, PAIRS))
def validated_lengths(spark, d):
    p = _pairs(spark, d).select("rec_no", "len", (F.col("c_pos") - F.col("pos")).alias("d_start"), (C.variant_end(F.col("overall_type"), F.col("c_pos"), F.col("c_len")) - C.variant_end(F.col("overall_type"), F.col("pos"), F.col("len"))).alias("d_end"), (F.col("c_len") - F.col("len")).alias("d_len"))
    out = match.validated_lengths(p, "rec_no")
    return out.withColumns({c: F.col(c).cast("long") for c in ("validated", "d_start", "d_end", "d_len")})


def _quantile_sql(p: float) -> str:
    at = f"((n+1)*{p}::double)"
    value = lambda i: f"min(case when rn>=least(greatest({i},1),n) then x end)"
    return f"round({value(f'floor({at})')} + max(case when {at}>=1 and {at}<n then {at}-floor({at}) else 0 end)*({value(f'floor({at})+1')}-{value(f'floor({at})')}), 6) as p{int(p * 100):02d}"


@register("distance_summary", _sql("truth calls", "select overall_type, count(*) as n, max(x) as max, min(x) as min, round(avg(x),6) as mean, cast(sum(x) as bigint) as sum, round(var_samp(x),6) as variance, " + ", ".join(_quantile_sql(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", " + ", ".join(f"cast(sum(case when x={i} then 1 else 0 end) as bigint) as n_{i}" for i in (0, 1, 2)) + " from (select overall_type, x, row_number() over (partition by overall_type order by x) as rn, count(*) over (partition by overall_type) as n from (select overall_type, abs(c_pos-pos) as x from pairs)) group by overall_type", TIV, CIV, PAIRS))
def distance_summary(spark, d):
    rows = _pairs(spark, d).select("overall_type", F.abs(F.col("c_pos") - F.col("pos")).alias("x"))
    out = stats.distance_summary(rows, "x", ("overall_type",))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "p05", "p25", "p50", "p75", "p95")})


_CONSTRAINTS = [("c1", "SNP", 1, 1, "TPR", "GT", 0.7), ("c2", "SNP", 1, 1, "FDR", "LT", 0.05), ("c3", "Deletion", 1, 99, "F1", "GT", 0.5), ("c4", "TandemDup", 100, 1000, "TPR", "GT", 0.9), ("c5", "Inversion", 1, 1000, "F1", "GT", 0.1), ("c6", "Insertion", 1, 400, "FDR", "LT", 0.2)]


@register("constraints", _sql("truth calls", "select name, tp, fp, t, round(v, 6) as value, coalesce(case when op='GT' then v>cutoff else v<cutoff end, false) as holds from (select *, case metric when 'F1' then case when t<>0 and tp+fp<>0 and (1-fp::double/(fp+tp)+tp::double/t)<>0 then 2*(1-fp::double/(fp+tp))*(tp::double/t)/(1-fp::double/(fp+tp)+tp::double/t) end when 'TPR' then case when t<>0 then tp::double/t end else case when tp+fp<>0 then fp::double/(tp+fp) end end as v from (select c.name, c.metric, c.op, c.cutoff, cast(count(case when outcome='TP' then 1 end) as bigint) as tp, cast(count(case when outcome='FP' then 1 end) as bigint) as fp, cast(count(case when outcome in ('TP','FN') then 1 end) as bigint) as t from cons c left join outcomes o on o.overall_type=c.overall_type and o.len between c.lo and c.hi group by 1, 2, 3, 4))", *_ALL, "cons as (select * from (values " + ", ".join(f"('{n}','{k}',{lo},{hi},'{m}','{op}',{x}::double)" for n, k, lo, hi, m, op, x in _CONSTRAINTS) + ") v(name, overall_type, lo, hi, metric, op, cutoff))"))
def constraints(spark, d):
    c = spark.createDataFrame(_CONSTRAINTS, "name string, overall_type string, lo int, hi int, metric string, op string, cutoff double")
    return cohort.check_constraints(c, _outcomes(spark, d)).select("name", "tp", "fp", "t", F.round("value", 6).alias("value"), "holds")


_SAMPLES = f"samples as (select cast(rec_no%8 as int) as sample, overall_type, {_COUNT} from outcomes group by 1, 2)"


def _per_sample(spark: SparkSession, d: str) -> DataFrame:
    o = _outcomes(spark, d).withColumn("sample", (F.col("rec_no") % 8).cast("int"))
    is_ = lambda *n: F.count_if(F.col("outcome").isin(*n))
    return o.groupBy("sample", "overall_type").agg(is_("TP").alias("tp"), is_("FP").alias("fp"), is_("TP", "FN").alias("t"))


@register("cohort_totals", _sql("truth calls", "select grp, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(t) as bigint) as t, cast(sum(t)-sum(tp) as bigint) as fn, round(100*sum(tp)::double/sum(t), 6) as tpr, round(100*sum(fp)::double/(sum(tp)+sum(fp)), 6) as fdr from (select 'all' as grp, tp, fp, t from samples union all select 'snp', tp, fp, t from samples where overall_type='SNP' union all select 'ins', tp, fp, t from samples where overall_type='Insertion' union all select 'del', tp, fp, t from samples where overall_type='Deletion' union all select 'indel', tp, fp, t from samples where overall_type in ('Insertion','Deletion')) group by grp", *_ALL, _SAMPLES))
def cohort_totals(spark, d):
    return cohort.cohort_totals(_per_sample(spark, d)).select("grp", "tp", "fp", "t", "fn", F.round("tpr", 6).alias("tpr"), F.round("fdr", 6).alias("fdr"))


@register("cohort_spread", _sql("truth calls", "select overall_type, count(*) as n, round(avg(v),6) as mean, list_sort(list(v))[cast(floor(count(*)*(1-50.0/100)) as bigint)+1] as median, list_sort(list(v))[cast(floor(count(*)*(1-95.0/100)) as bigint)+1] as p05_index from (select overall_type, round(case when t<>0 then tp::double/t end, 6) as v from samples) where v is not null group by overall_type", *_ALL, _SAMPLES))
def cohort_spread(spark, d):
    per = _per_sample(spark, d).withColumn("tpr", F.round(C.ratio(F.col("tp"), F.col("t")), 6))
    return cohort.cohort_spread(per, "tpr", ("overall_type",)).withColumn("mean", F.round("mean", 6))


# -- sets ----------------------------------------------------------------------------------------------------

_KEY = ("chr", "pos", "overall_type", "alt")
_BOTH = "both_ as (select 0 as file_no, rec_no, chr, pos, overall_type, alt from truth union all select 1, rec_no, chr, pos, overall_type, alt from calls)"


def _keyed(spark: SparkSession, d: str) -> list[DataFrame]:
    return [view(spark, d, n).select("rec_no", *_KEY) for n in ("truth", "calls")]


@register("combine_first", _sql("truth calls", "select file_no, rec_no from (select *, row_number() over (partition by chr, pos, overall_type, alt order by file_no, rec_no) as rn from both_) where rn=1", _BOTH))
def combine_first(spark, d):
    return setops.combine(_keyed(spark, d), "first", _KEY).select("file_no", "rec_no")


@register("combine_unique", _sql("truth calls", "select file_no, rec_no from (select *, count(*) over (partition by chr, pos, overall_type, alt) as n from both_) where n=1", _BOTH))
def combine_unique(spark, d):
    return setops.combine(_keyed(spark, d), "unique", _KEY).select("file_no", "rec_no")


@register("merge_augmented", _sql("truth calls", "select 'FN' as part, count(*) as n, cast(sum(rec_no) as bigint) as ids from known k where not exists (select 1 from tp2 t where t.chr=k.chr and t.pos=k.pos and t.overall_type=k.overall_type and t.alt=k.alt) union all select 'TP', count(*), cast(sum(rec_no) as bigint) from tp2 union all select 'T', count(*), cast(sum(rec_no) as bigint) from known union all select 'FP', count(*), cast(sum(rec_no) as bigint) from cfalse f where not exists (select 1 from (select * from cfalse where rec_no%5=0) r where r.chr=f.chr and r.pos=f.pos and r.overall_type=f.overall_type and r.alt=f.alt)",
    TIV, CIV, PAIRS, "hit as (select * from truth t where exists (select 1 from pairs p where p.rec_no=t.rec_no))", "miss as (select * from truth t where not exists (select 1 from pairs p where p.rec_no=t.rec_no))", "cfalse as (select * from calls c where not exists (select 1 from pairs p where p.c_rec_no=c.rec_no))",
    "tp2 as (select * from (select *, row_number() over (partition by chr, pos, overall_type, alt order by f, rec_no) as rn from (select 0 as f, * from hit union all select 1, * from miss where rec_no%5=0)) where rn=1)", "known as (select * from (select *, row_number() over (partition by chr, pos, overall_type, alt order by f, rec_no) as rn from (select 0 as f, * from hit union all select 1, * from miss)) where rn=1)"))
def merge_augmented(spark, d):
    truth, calls = _keyed(spark, d)
    pairs = _pairs(spark, d)
    hit = truth.join(pairs.select("rec_no").distinct(), "rec_no", "left_semi")
    miss = truth.join(pairs.select("rec_no").distinct(), "rec_no", "left_anti")
    false = calls.join(pairs.select(F.col("c_rec_no").alias("rec_no")).distinct(), "rec_no", "left_anti")
    fifth = lambda df: df.filter("rec_no % 5 = 0")  # noqa: E731  the results that a second matcher is taken to rescue
    parts = setops.merge_results(hit, false, miss, fifth(miss), fifth(false), _KEY)
    count = lambda name: parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("rec_no").alias("ids")).select("part", "n", "ids")
    return count("TP").unionByName(count("T")).unionByName(count("FN")).unionByName(count("FP"))


@register("only_once", _sql("truth calls", "select chr, pos, overall_type, alt from both_ group by 1, 2, 3, 4 having count(*)=1", _BOTH))
def only_once(spark, d):
    return setops.only_once(*_keyed(spark, d), key=_KEY).select(*_KEY)


@register("except_keys", _sql("truth calls", "select t.rec_no from truth t where not exists (select 1 from calls c where c.chr=t.chr and c.pos=t.pos and c.overall_type=t.overall_type and c.alt=t.alt)"))
def except_keys(spark, d):
    return setops.except_keys(*_keyed(spark, d), _KEY).select("rec_no")


@register("concat_files", _sql("truth calls", "select file_no, count(*) as n, cast(sum(file_no*1099511627776 + rec_no) as bigint) as ids from both_ group by file_no", _BOTH))
def concat_files(spark, d):
    return setops.concat_files(*_keyed(spark, d)).groupBy("file_no").agg(F.count("*").alias("n"), F.sum("rec_no").alias("ids"))


@register("filtered_variants", _sql("calls", "select rec_no from calls where (filter like '%PASS%' or filter='.') and chr in ('chr1','chr3') and len between 2 and 60 and not gt='0|0'"))
def filtered_variants(spark, d):
    rows = _alleles(view(spark, d, "calls")).filter(C.pass_only(F.col("filter")) & C.is_nonref(F.col("gt_p"), F.col("gt_m")))
    return setops.len_between(setops.chr_in(rows, ["chr1", "chr3"]), 2, 60, "len", "len").select("rec_no")


@register("traid_composites", _sql("truth", "select traid, pair, case when min(overall_type)=max(overall_type) then min(overall_type) else 'Complex' end as composite_type from (select rec_no, overall_type, 't'||cast(rec_no//30 as varchar) as traid, (row_number() over (partition by rec_no//30 order by rec_no)-1)//2 as pair from truth) group by traid, pair having count(*)=2"))
def traid_composites(spark, d):
    rows = view(spark, d, "truth").withColumn("traid", F.concat(F.lit("t"), F.floor(F.col("rec_no") / 30).cast("string")))
    kind = F.when(F.col("overall_type") == "TandemDup", "Tandem_Duplication").otherwise(F.col("overall_type"))
    pairs = setops.pair_by_traid(rows.select("rec_no", "traid"))
    return canonical.compose_traid(rows.select("rec_no", F.array(kind).alias("types")), pairs).select("traid", "pair", "composite_type").distinct()


@register("split_flag", _sql("truth", "select rec_no, coalesce(total>=100 and big>=total*0.8::double and n>1, false) as split from (select rec_no, sum(len) over (partition by rec_no//16) as total, max(len) over (partition by rec_no//16) as big, count(*) over (partition by rec_no//16) as n from truth)"))
def split_flag(spark, d):
    rows = view(spark, d, "truth").withColumn("whole", F.floor(F.col("rec_no") / 16))
    return match.split_flag(rows, "whole", RATIO).select("rec_no", "split")


@register("sample_exact", _sql("truth", "select rec_no from (select *, row_number() over (partition by overall_type order by rec_no*7919%10007, rec_no) as rn from truth) where rn <= case overall_type when 'SNP' then 500 when 'Insertion' then 200 when 'Deletion' then 100000 else 0 end"))
def sample_exact(spark, d):
    return setops.sample_exact(view(spark, d, "truth"), {"SNP": 500, "Insertion": 200, "Deletion": 100000}, F.col("rec_no") * 7919 % 10007).select("rec_no")


@register("natural_order_rank", _sql("truth", "select rec_no, row_number() over (order by cast(substr(chr,4) as int), pos, alt, rec_no) - 1 as number from truth"))
def natural_order_rank(spark, d):
    rows = view(spark, d, "truth").withColumn("nat", C.natural_key(F.col("chr")))
    return setops.number_rows(rows, ("nat", "pos", "alt", "rec_no")).select("rec_no", "number")


@register("traid_pairs", _sql("truth", "select traid, pair, min(rec_no) as first_rec, max(rec_no) as second_rec from (select rec_no, 't'||cast(rec_no//30 as varchar) as traid, (row_number() over (partition by rec_no//30 order by rec_no)-1)//2 as pair from truth) group by traid, pair having count(*)=2"))
def traid_pairs(spark, d):
    rows = view(spark, d, "truth").select("rec_no", F.concat(F.lit("t"), F.floor(F.col("rec_no") / 30).cast("string")).alias("traid"))
    return setops.pair_by_traid(rows).select("traid", "pair", F.element_at("members", 1).alias("first_rec"), F.element_at("members", 2).alias("second_rec"))


@register("tag_somatic", _sql("truth", "select rec_no, case when rec_no%3=0 then 'COSMIC'||cast(rec_no as varchar) else case when rec_no%3=1 then '' else 'id'||cast(rec_no as varchar)||',' end || 'SOMATIC_' || cast(sum(case when rec_no%3=0 then 0 else 1 end) over (partition by rec_no%4 order by rec_no rows unbounded preceding)-1 as varchar) end as id from truth"))
def tag_somatic(spark, d):
    own = F.when(F.col("rec_no") % 3 == 0, F.concat(F.lit("COSMIC"), F.col("rec_no").cast("string"))).when(F.col("rec_no") % 3 == 1, ".").otherwise(F.concat(F.lit("id"), F.col("rec_no").cast("string")))
    return setops.tag_somatic(view(spark, d, "truth").select("rec_no", (F.col("rec_no") % 4).alias("file_no"), own.alias("id"))).select("rec_no", "id")


# -- regions and text ----------------------------------------------------------------------------------------


@register("restrict_regions", _sql("truth regions", "select t.rec_no, r.chr||'_'||cast(r.start_pos as varchar)||'_'||cast(r.end_pos as varchar) as chr, t.s-r.start_pos+1 as start_pos, t.e-r.start_pos+1 as end_pos from tiv t join regions r on t.chr=r.chr and t.s>=r.start_pos+10 and t.e<=r.end_pos-10", TIV))
def restrict_regions(spark, d):
    rows = _truth(spark, d).select("rec_no", "chr", "start", "end")
    return intervals.restrict_to_regions(rows, _regions(spark, d), 10).select("rec_no", "chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@register("unrestrict_regions", _sql("truth regions", "select t.rec_no, t.chr, t.s as pos from tiv t join regions r on t.chr=r.chr and t.s>=r.start_pos+10 and t.e<=r.end_pos-10", TIV))
def unrestrict_regions(spark, d):
    inside = intervals.restrict_to_regions(_truth(spark, d).select("rec_no", "chr", "start", "end"), _regions(spark, d), 10)
    return liftover.lift_region_variants(inside.select("rec_no", "chr", F.col("start").alias("pos")))


@register("convert_cn", _sql("truth", "select rec_no, cast(greatest(len%5, rec_no%4) as varchar) as cn_max, case when gt='1|1' then cast(len%5 as varchar)||'|'||cast(len%5 as varchar) else '1|'||cast(len%5 as varchar) end as cn_each from truth"))
def convert_cn(spark, d):
    one = (F.col("len") % 5).cast("string")
    both = F.concat_ws("/", one, (F.col("rec_no") % 4).cast("string"))
    return view(spark, d, "truth").select("rec_no", C.convert_cn(both).alias("cn_max"), C.convert_cn(one, F.col("gt")).alias("cn_each"))


@register("allele_fraction", _sql("truth", "select rec_no, case when len+rec_no%7=0 then 0.0 else round((rec_no%7)::double/(len+rec_no%7),4) end as from_ad, case when rec_no%5=0 then null when len%3+rec_no%7=0 then 0.0 else round((rec_no%7)::double/(len%3+rec_no%7),4) end as from_ao from truth"))
def allele_fraction(spark, d):
    none = F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    ad = F.concat_ws(",", text(F.col("len")), text(F.col("rec_no") % 7))
    ro = F.when(F.col("rec_no") % 5 != 0, text(F.col("len") % 3))
    return view(spark, d, "truth").select("rec_no", C.allele_fraction(ad, none, none).cast("double").alias("from_ad"), F.nullif(C.allele_fraction(none, text(F.col("rec_no") % 7), ro), F.lit("N/A")).cast("double").alias("from_ao"))


#: Letters become bases: only A-Z and a-z, as engines differ in the case of others.
_LETTERS, _AS_BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "AACCGTTGNAACCNGGTTNACGTNACACGTNACGTNACGTNACGTNACGTNA"
_BASES = f"translate(text, '{_LETTERS}', '{_AS_BASES}')"


@register("reverse_complement", "select doc_id, md5(translate(reverse(regexp_replace(" + _BASES + ", '[^ACGTN]', '', 'g')), 'ACGT', 'TGCA')) as rc from documents")
def reverse_complement(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bases = F.regexp_replace(F.translate("text", _LETTERS, _AS_BASES), "[^ACGTN]", "")
    return docs.select("doc_id", F.md5(C.rev_comp(bases)).alias("rc"))


@register("non_n_count", "select source, cast(sum(length(regexp_replace(regexp_replace(" + _BASES + ", '[^ACGTN]', '', 'g'), '[Nn]', '', 'g'))) as bigint) as non_n from documents group by source")
def non_n_count(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bases = F.regexp_replace(F.translate("text", _LETTERS, _AS_BASES), "[^ACGTN]", "")
    return docs.groupBy("source").agg(F.sum(C.non_n(bases)).alias("non_n"))


def _alleles_text(df: DataFrame) -> DataFrame:
    """REF and ALT text of up to a few bases, from a record's number."""
    base = lambda k: F.substring("ACGT", 1, 1) if k is None else F.substr(F.lit("ACGTACGTAC"), (F.col("rec_no") % k + 1).cast("int"), (F.col("rec_no") % 5 + 1).cast("int"))
    other = F.substr(F.lit("ACGATCGTCA"), (F.col("len") % 4 + 1).cast("int"), (F.col("len") % 4 + 1).cast("int"))
    return df.withColumns({"ref": base(4), "alt_text": F.concat(F.substr(base(4), F.lit(1), (F.col("len") % 3).cast("int")), other)})


@register("trim_clip", _sql("truth", "select rec_no, p as shift, length(r)-p-q as ref_len, length(a)-p-q as alt_len from (select *, coalesce((select max(k) from range(0, 12) x(k) where k<=least(length(r), length(a))-p and right(r, k)=right(a, k)), 0) as q from (select *, coalesce((select max(k) from range(0, 12) x(k) where k<=least(length(r), length(a)) and left(r, k)=left(a, k)), 0) as p from (select rec_no, substr('ACGTACGTAC', cast(rec_no%4+1 as int), cast(rec_no%5+1 as int)) as r, substr(substr('ACGTACGTAC', cast(rec_no%4+1 as int), cast(rec_no%5+1 as int)), 1, cast(len%3 as int))||substr('ACGATCGTCA', cast(len%4+1 as int), cast(len%4+1 as int)) as a from truth)))"))
def trim_clip(spark, d):
    rows = _alleles_text(view(spark, d, "truth"))
    t = rows.withColumn("t", C.trim_prefix(F.col("ref"), F.array("alt_text"))).withColumn("s", C.clip_suffix(F.col("t.ref"), F.col("t.alts")))
    return t.select("rec_no", F.col("t.shift").cast("long").alias("shift"), F.length("s.ref").cast("long").alias("ref_len"), F.length(F.element_at("s.alts", 1)).cast("long").alias("alt_len"))


_CANONICAL = (
    "texts as (select *, substr(r, 1, cast(len%3 as int))||substr('ACGATCGTCA', cast(len%4+1 as int), cast(len%4+1 as int)) as a, gt='1|1' as hom from (select *, substr('ACGTACGTAC', cast(rec_no%4+1 as int), cast(rec_no%5+1 as int)) as r from truth))",
    "cut as (select rec_no, chr, hom, pos+n as pos, substr(r, cast(n+1 as int)) as r, substr(a, cast(n+1 as int)) as a, length(a)-length(r) as more from (select *, case when hom then coalesce((select max(k) from range(0, 12) x(k) where k<=least(length(r), length(a)) and left(r, k)=left(a, k)), 0) else 0 end as n from texts where not (length(r)=1 and length(a)=1)))",
    "sides as (select *, case when side='r' then length(a) else 0 end as kept, case when side='r' then i else i+more end as opposite from (select *, unnest(range(0, length(r)+1)) as i from (select *, unnest(['l', 'r']) as side from cut)))",
    "pieces as (select rec_no, chr, hom, side, i, case when more>0 then case when side='r' then pos+length(r) else pos end else pos+kept end as pos, case when more>0 then '' else substr(r, cast(kept+1 as int), cast(-more as int)) end as ref, case when more>0 then substr(a, 1, cast(more as int)) else '' end as alt from sides where i=0 and more<>0 union all select rec_no, chr, hom, side, i, pos+i-1, substr(r, cast(i as int), 1), substr(a, cast(opposite as int), 1) from sides where i>0 and opposite between 1 and length(a) and substr(a, cast(opposite as int), 1)<>substr(r, cast(i as int), 1))",
    "sizes as (select rec_no, count(case when side='l' then 1 end) as nl, count(case when side='r' then 1 end) as nr from pieces group by rec_no)",
)


@register("canonicalize", _sql("truth", "select rec_no, cast(row_number() over (partition by rec_no order by i)-1 as int) as piece_no, chr, cast(pos as bigint) as pos, ref, alt, cast(null as varchar) as alt2, cast(case when hom then 1 else 0 end as int) as gt_p, cast(1 as int) as gt_m from (select p.* from pieces p join sizes s on s.rec_no=p.rec_no and p.side=case when nr<nl then 'r' else 'l' end union all select rec_no, chr, hom, 'l', 0, pos, r, a from texts where length(r)=1 and length(a)=1)", *_CANONICAL))
def canonicalize(spark, d):
    rows = _alleles(_alleles_text(view(spark, d, "truth"))).withColumn("alts", F.array("alt_text"))
    return canonical.canonicalize(rows)


# -- assignment and maps -------------------------------------------------------------------------------------


def _assigned(need: str = "") -> str:
    """Rounds of an ordered assignment over edges (call, piece, truth, best: less is better, len), as a CTE: taken
    edges, with the longest truth that was free; need: the pieces that a call must match, if it must."""
    full = f" and count(case when best=choice then 1 end) over (partition by call) = {need}" if need else ""
    more = f", {need}" if need else ""
    return f"""st as (
  select 0 as round, call, piece, truth, best, len{more}, 0 as matched, false as taken from edges
  union all
  select round+1, call, piece, truth, best, len{more}, longest, chosen from (
    select *, bool_or(chosen) over (partition by truth) as gone from (
      select *, not waiting and best=choice{full} as chosen from (
        select *, bool_or(holder<call) over (partition by call) as waiting, max(len) over (partition by call, piece) as longest from (
          select *, min(call) over (partition by truth) as holder, min(best) over (partition by call, piece) as choice from st where not taken))))
  where chosen or (waiting and not gone))"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@register("greedy_match", _recursive(_sql("truth calls", "select call, call as call_order, piece, truth from st where taken", TIV, CIV, PAIRS, "edges as (select distinct c_rec_no as call, cast(0 as int) as piece, rec_no as truth, rec_no as best, 0 as len from pairs)", _assigned())))
def greedy_match(spark, d):
    edges = _pairs(spark, d).select(F.col("c_rec_no").alias("call"), F.col("c_rec_no").alias("call_order"), F.lit(0).alias("piece"), F.col("rec_no").alias("truth"), F.col("rec_no").alias("truth_order"))
    return match.greedy_match(edges)


_WHOLE_EDGES = "edges as (select distinct c_rec_no//16 as call, c_rec_no%16 as piece, rec_no as truth, rec_no as best, 0 as len, pieces from pairs join (select rec_no//16 as c, count(*) as pieces from calls group by 1) on c=c_rec_no//16)"


@register("greedy_match_whole", _recursive(_sql("truth calls", "select call, call as call_order, piece, truth from st where taken", TIV, CIV, PAIRS, _WHOLE_EDGES, _assigned("pieces"))))
def greedy_match_whole(spark, d):
    edges = _pairs(spark, d).select(F.floor(F.col("c_rec_no") / 16).alias("call"), F.floor(F.col("c_rec_no") / 16).alias("call_order"), (F.col("c_rec_no") % 16).alias("piece"), F.col("rec_no").alias("truth"), F.col("rec_no").alias("truth_order"))
    pieces = view(spark, d, "calls").groupBy(F.floor(F.col("rec_no") / 16).alias("call")).agg(F.count("*").alias("pieces"))
    return match.match_whole_calls(edges, pieces)


@register("greedy_match_unique", _sql("truth calls", "select c_rec_no as call, rec_no as truth from (select *, count(*) over (partition by rec_no) as a, count(*) over (partition by c_rec_no) as b from pairs) where a=1 and b=1", TIV, CIV, PAIRS))
def greedy_match_unique(spark, d):
    p = _pairs(spark, d).select("rec_no", "c_rec_no")
    once = p.withColumn("a", F.count("*").over(Window.partitionBy("rec_no"))).withColumn("b", F.count("*").over(Window.partitionBy("c_rec_no"))).filter("a = 1 and b = 1")
    matched = greedy_match(spark, d).select("call", "truth")
    return matched.join(once, (matched["call"] == once["c_rec_no"]) & (matched["truth"] == once["rec_no"])).select("call", "truth")


def _haplotype(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("len")
    return view(spark, d, "truth").select("rec_no", "chr", "pos", F.when(F.col("overall_type") == "Insertion", 0).otherwise(size).cast("int").alias("ref_len"), size.alias("ins_len"), "overall_type", F.lit(2).alias("cn"))


def _contigs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "truth").groupBy(F.col("chr").alias("contig")).agg((F.max("pos") + 2000).alias("length"))


#: Accepted variants: of those that change bases, from the first of each island on the next one that starts behind.
_KEPT = (
    "contigs as (select chr as contig, max(pos)+2000 as length from truth group by chr)",
    "hap as (select rec_no, chr, pos, overall_type, case when overall_type='Insertion' then 0 else len end as ref_len, len as ins_len from truth join contigs on chr=contig where pos>=1 and pos+(case when overall_type='Insertion' then 0 else len end)-1<=length)",
    "isl as materialized (select *, sum(head) over (partition by chr order by pos, rec_no) as island from (select *, case when pos > coalesce(max(pos+ref_len-1) over (partition by chr order by pos, rec_no rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as head from hap where ref_len>0))",
    "nxt as materialized (select a.rec_no, min({'p': b.pos, 'r': b.rec_no}).r as nxt from isl a join isl b on a.chr=b.chr and a.island=b.island and b.pos > a.pos+a.ref_len-1 group by a.rec_no)",
    "path as (select rec_no from isl where head=1 union all select n.nxt from path k join nxt n on k.rec_no=n.rec_no)",
    "del as materialized (select h.* from hap h join path using (rec_no) where overall_type='Deletion')",
    "shut as (select i.rec_no from hap i join del d on d.chr=i.chr and d.pos<=i.pos and d.pos+d.ref_len-1>=i.pos-1 where i.ref_len=0 and (d.pos<i.pos or (d.pos=i.pos and d.rec_no<i.rec_no)) group by i.rec_no having bool_or(d.pos<=i.pos-1) and bool_or(d.pos+d.ref_len-1>=i.pos))",
    "kept as materialized (select * from hap where rec_no in (select rec_no from path) union all select i.* from hap i where ref_len=0 and rec_no in (select min(rec_no) from hap where ref_len=0 and rec_no not in (select rec_no from shut) group by chr, pos))",
)


@register("drop_conflicts", _recursive(_sql("truth", "select rec_no, chr, pos, overall_type from kept", *_KEPT)))
def drop_conflicts(spark, d):
    return mapbuild.drop_conflicts(_haplotype(spark, d), _contigs(spark, d)).select("rec_no", "chr", "pos", "overall_type")


_BLOCKS = (
    "big as (select *, case overall_type when 'Insertion' then 'INS' when 'Deletion' then 'DEL' else 'DUP_TANDEM' end as f, pos + case when overall_type='Deletion' then ref_len else 0 end as e from kept where overall_type<>'SNP')",
    "seen as (select *, coalesce(lag(e) over (partition by chr order by pos, rec_no), 1) as after_ from big)",
    "blocks as (select chr, after_ as ref_at, pos-after_ as size, 'SEQ' as feature, null as rec_no from seen union all select chr, pos, case when f='INS' then ins_len else ref_len end, f, rec_no from seen union all select contig, coalesce(last_, 1), length+1-coalesce(last_, 1), 'SEQ', null from contigs left join (select chr, max(e) as last_ from big group by chr) on chr=contig)",
    "placed as (select *, row_number() over w as n, sum(case when feature='DEL' then 0 else size end) over w - case when feature='DEL' then 0 else size end + 1 as src from blocks where size>0 window w as (partition by chr order by ref_at, feature='SEQ', rec_no nulls first rows unbounded preceding))",
)


@register("block_map", _recursive(_sql("truth", "select cast(n as int) as block_no, cast(size as bigint) as size, chr||'_paternal' as src_chr, cast(src - case when feature='DEL' then 1 else 0 end as bigint) as src_loc, chr as dst_chr, cast(ref_at - case when feature in ('SEQ','DEL') then 0 else 1 end as bigint) as dst_loc, '+' as direction, feature, cast(rec_no as varchar) as variant_id from placed", *_KEPT, *_BLOCKS)))
def block_map(spark, d):
    kept = mapbuild.drop_conflicts(_haplotype(spark, d), _contigs(spark, d))
    return mapbuild.build_block_map(kept, _contigs(spark, d))


@register("annotate_false", _sql("truth calls", "select f.rec_no, min(c.rec_no) as caller_rec, min(n.rec_no) as nearest_id, min(n.distance) as distance from (select * from calls c where not exists (select 1 from pairs p where p.c_rec_no=c.rec_no)) f left join calls c on c.chr=f.chr and c.pos=f.pos and c.overall_type=f.overall_type and c.alt=f.alt left join (select * from (select g.rec_no as f_rec, t.rec_no, abs(t.pos-g.pos) as distance, row_number() over (partition by g.rec_no order by abs(t.pos-g.pos), t.rec_no) as rn from calls g join truth t on t.chr=g.chr and t.pos between g.pos-99 and g.pos+99) where rn=1) n on n.f_rec=f.rec_no group by f.rec_no", TIV, CIV, PAIRS))
def annotate_false(spark, d):
    calls, pairs = view(spark, d, "calls"), _pairs(spark, d)
    false = calls.join(pairs.select(F.col("c_rec_no").alias("rec_no")).distinct(), "rec_no", "left_anti").select("rec_no", "chr", "pos", F.col("overall_type").alias("ref"), "alt")
    caller = calls.select("rec_no", "chr", "pos", F.col("overall_type").alias("ref"), "alt", F.col("rec_no").alias("af"), F.lit(1).alias("dp"))
    master = view(spark, d, "truth").select("rec_no", "chr", "pos", F.col("rec_no").alias("id"))
    return cohort.annotate_false(false, caller, master).select("rec_no", F.col("af").alias("caller_rec"), "nearest_id", "distance")


# -- codecs and files: registered where they are defined -----------------------------------------------------

from verisect import codec_queries  # noqa: E402, F401
from verisect import job_queries  # noqa: E402, F401
