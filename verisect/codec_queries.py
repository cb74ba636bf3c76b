"""Registered queries of text codecs, expressions on variants, and files that are written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators import match, setops
from verisect.operators.storage import new_path, numbered, placed, stored
from verisect.plans import jobs
from verisect.plans.projections import view
from verisect.queries import _HAP, _LADDER, _STATUS, CIV, PAIRS, TIV, _breaks, _pairs, _sql, register
from verisect.sources import sinks, text, vcf


def pick(values: list[str], by: str) -> Column:
    """One of the values, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) % len(values) + 1).cast("int"))


def pick_sql(values: list[str], by: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[cast(({by}) % {len(values)} as int) + 1]"


CHROMOSOMES = ["chr1", "chrX", "Y", "chrM", "MT", "X_paternal", "Chr2", "chrY_maternal", "Xq"]
_BARE = "chroms as (select *, case when b='M' then 'MT' else b end as bare from (select *, regexp_replace(name, '^[cC][hH][rR]', '') as b from (select *, " + pick_sql(CHROMOSOMES, "rec_no//8") + " as name from truth)))"
_SEX = "sexes as (select *, regexp_matches(bare, '^X(_|$)') as x, regexp_matches(bare, '^Y(_|$)') as y, regexp_matches(bare, '^MT?(_|$)') as mt from chroms)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "truth").withColumn("name", pick(CHROMOSOMES, "rec_no div 8"))


@register("chromosome_names", _sql("truth", "select rec_no, bare, x, y, mt, x or y or mt as alone_male, y or mt as alone_female from sexes", _BARE, _SEX))
def chromosome_names(spark, d):
    n = F.col("name")
    return _named(spark, d).select("rec_no", C.strip_chr(n).alias("bare"), C.is_x(n).alias("x"), C.is_y(n).alias("y"), C.is_mt(n).alias("mt"), C.is_haploid(n, True).alias("alone_male"), C.is_haploid(n, False).alias("alone_female"))


GENOTYPES = ["0|1", "1/1", ".", "1", "./1", "2|1", "0/0", "1|.", "0|2"]


@register("genotypes", _sql("truth", "select rec_no, p, m, phased, p=m and p>0 as hom, not (p=0 and m=0) as nonref, cast(case when p>=0 then p when mt or x then -1 else 1 end as int) as eff_p, cast(case when m>=0 then m when y then -1 else least(2, 1+len%2) end as int) as eff_m from (select *, cast(case when alone then case when x or mt then -1 else coalesce(f,-1) end when f is not null and s is not null then f else -1 end as int) as p, cast(case when alone then case when y then -1 else coalesce(f,-1) end when f is not null and s is not null then s else -1 end as int) as m, contains(g,'|') as phased from (select *, len(string_split_regex(g,'[/|]'))=1 as alone, try_cast(string_split_regex(g,'[/|]')[1] as int) as f, try_cast(string_split_regex(g,'[/|]')[2] as int) as s from (select *, " + pick_sql(GENOTYPES, "len") + " as g from sexes)))", _BARE, _SEX))
def genotypes(spark, d):
    rows = _named(spark, d).withColumn("g", C.parse_gt(pick(GENOTYPES, "len"), F.col("name")))
    rows = rows.select("rec_no", "len", "name", "g.*").withColumn("e", C.effective_alleles(F.col("p"), F.col("m"), F.col("len") % 2 + 1, F.col("name")))
    return rows.select("rec_no", "p", "m", "phased", C.is_hom(F.col("p"), F.col("m")).alias("hom"), C.is_nonref(F.col("p"), F.col("m")).alias("nonref"), F.col("e.p").alias("eff_p"), F.col("e.m").alias("eff_m"))


FORMATS, SAMPLES = ["GT:AD:DP", "DP:GT", "AD", "GT", "GT:DP:AD"], ["0|1:3,4:7", "9:1/1", "5,6", "."]


@register("format_fields", _sql("truth", "select rec_no, cast(coalesce(nullif(i,0)-1,-1) as int) as at, case when i>0 then string_split(s,':')[cast(i as int)] end as value from (select *, coalesce(list_position(string_split(f,':'),'AD'),0) as i from (select *, " + pick_sql(FORMATS, "rec_no") + " as f, " + pick_sql(SAMPLES, "len") + " as s from truth))"))
def format_fields(spark, d):
    f, s = pick(FORMATS, "rec_no"), pick(SAMPLES, "len")
    return view(spark, d, "truth").select("rec_no", C.format_index(f, "AD").alias("at"), C.format_value(f, s, "AD").alias("value"))


_INFO = "'SVLEN='||cast(len as varchar)||',-'||cast(rec_no%7 as varchar)||';.;END='||cast(pos as varchar)||'=x;IMPRECISE'||case when rec_no%3=0 then ';SVLEN=9;END=1' else '' end"


@register("info_fields", _sql("truth", r"select rec_no, regexp_extract(i, '^SVLEN=([^;]*)', 1) as svlen, regexp_extract(i, ';END=([^;]*)', 1) as end_text, 'true' as flag, cast(null as varchar) as absent, cast(len as bigint) as first_size, cast(-(rec_no%7) as bigint) as second_size, regexp_replace(i, ';SVLEN=9;END=1$', '') as once from (select *, " + _INFO + " as i from truth)"))
def info_fields(spark, d):
    extra = F.when(F.col("rec_no") % 3 == 0, ";SVLEN=9;END=1").otherwise("")
    i = F.concat(F.lit("SVLEN="), F.col("len").cast("string"), F.lit(",-"), (F.col("rec_no") % 7).cast("string"), F.lit(";.;END="), F.col("pos").cast("string"), F.lit("=x;IMPRECISE"), extra)
    rows = view(spark, d, "truth").select("rec_no", i.alias("i")).withColumn("m", C.parse_info(F.col("i"))).withColumn("n", C.info_ints(F.col("m"), "SVLEN"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("rec_no", at("SVLEN").alias("svlen"), at("END").alias("end_text"), at("IMPRECISE").alias("flag"), at("NONE").alias("absent"), F.element_at("n", 1).alias("first_size"), F.element_at("n", 2).alias("second_size"), C.dedupe_info(F.col("i")).alias("once"))


ALTS = ["A", "acgtn", "<DEL>", "<DUP:TANDEM>", "<INS:ME:ALU>", "<CNV>", "<XYZ>", "<DUP:XX>", "A[chr2:99[", "]chr3:7]G", "[5:1[T", "AC]X:12]", "*", "<>"]
_SYM, _BND = r"^<([A-Za-z]+)(?::([A-Za-z]+))?(?::[^>]*)?>$", r"^([ACGTN]*)([\[\]])([^:\[\]]+):(\d+)[\[\]]([ACGTN]*)$"


@register("alt_alleles", _sql("truth", f"select rec_no, case when sym and major in ('DEL','INS','DUP','INV','CNV','BND') and coalesce(minor,'') in ('','TANDEM','ME','TRA','ISP') then 'symbolic' when bnd then 'breakend' when regexp_matches(a, '^[ACGTNacgtn]+$') then 'bases' end as kind, major, minor, case when bnd then regexp_extract(a, '{_BND}', 3) end as mate_chr, case when bnd then cast(regexp_extract(a, '{_BND}', 4) as bigint) end as mate_pos, case when bnd then regexp_matches(a, '^[ACGTN]') end as bases_left, case when bnd then contains(a, '[') end as forward, case when bnd then a end as again from (select *, case when sym then nullif(regexp_extract(a, '{_SYM}', 1), '') end as major, case when sym then nullif(regexp_extract(a, '{_SYM}', 2), '') end as minor from (select *, regexp_matches(a, '{_SYM}') as sym, regexp_matches(a, '{_BND}') as bnd from (select rec_no, {pick_sql(ALTS, 'rec_no + len')} as a from truth)))"))
def alt_alleles(spark, d):
    rows = view(spark, d, "truth").select("rec_no", pick(ALTS, "rec_no + len").alias("a")).withColumns({"s": C.symbolic_parts(F.col("a")), "b": C.parse_breakend(F.col("a"))})
    return rows.select("rec_no", C.classify_alt(F.col("a")).alias("kind"), "s.major", "s.minor", F.col("b.chr").alias("mate_chr"), F.col("b.pos").alias("mate_pos"), F.col("b.left").alias("bases_left"), "b.forward", C.format_breakend(F.col("b")).alias("again"))


REFS, SEQS = ["A", "", "AC", "ACG", "T", "GGT"], ["C", "", "GT", "G", "TTT", "ACG", "T"]
MAJORS, MINORS = ["DEL", "INS", "DUP", "INV", "CNV"], ["", "TRA", "ISP", "TANDEM"]
NAMES = ["DEL", "snp", "deletion", "ISP_DUP", "td_dup", "nothing", "CUT_PASTE_TRANS", "clpx", "Translocation"]
TYPES = ["SNP", "Reference", "Deletion", "Translocation_Duplication", "Translocation_Deletion", "MNP", "Interspersed_Duplication"]
_ONE = "case {t} when 'SNP' then 'SNP' when 'Deletion' then 'Deletion' when 'Translocation_Duplication' then 'TransDup' when 'Translocation_Deletion' then 'TransDel' when 'Interspersed_Duplication' then 'InterDup' else 'Complex' end"


@register("allele_types", _sql("truth", f"select rec_no, case when r='' and q='' then 'Reference' when length(r)=1 and length(q)=1 then 'SNP' when q='' then 'Deletion' when length(r)>length(q) and right(r, length(q))=q then 'Deletion' when r='' then 'Insertion' when length(r)=length(q) then 'MNP' else 'Complex' end as plain, case when minor='TRA' then case when major='DUP' then 'Translocation_Duplication' else 'Translocation_Deletion' end when major='INS' then 'Insertion' when major='DEL' then 'Deletion' when major='INV' then 'Inversion' when major='DUP' and minor='ISP' then 'Interspersed_Duplication' when major='DUP' then 'Tandem_Duplication' else 'Complex' end as named, case when a='Reference' and b='Reference' then 'Reference' when a=b or b='Reference' then {_ONE.format(t='a')} when a='Reference' then {_ONE.format(t='b')} when a like 'Transl%' and b like 'Transl%' then 'Translocation' else 'Complex' end as overall, case upper(n) when 'DEL' then 'Deletion' when 'SNP' then 'SNP' when 'DELETION' then 'Deletion' when 'ISP_DUP' then 'InterDup' when 'TD_DUP' then 'TandemDup' when 'CUT_PASTE_TRANS' then 'Translocation' when 'CLPX' then 'Complex' when 'TRANSLOCATION' then 'Translocation' end as alias from (select rec_no, {pick_sql(REFS, 'rec_no')} as r, {pick_sql(SEQS, 'len')} as q, {pick_sql(MAJORS, 'rec_no')} as major, {pick_sql(MINORS, 'len')} as minor, {pick_sql(NAMES, 'pos')} as n, {pick_sql(TYPES, 'rec_no')} as a, {pick_sql(TYPES, 'len')} as b from truth)"))
def allele_types(spark, d):
    none = F.lit(None).cast("string")
    alt = lambda kind, major, minor, seq: F.struct(F.lit(kind).alias("kind"), major.alias("sv_major"), minor.alias("sv_minor"), seq.alias("seq"), F.length(seq).alias("alt_len"))
    ref, seq = pick(REFS, "rec_no"), pick(SEQS, "len")
    symbolic = alt("symbolic", pick(MAJORS, "rec_no"), F.nullif(pick(MINORS, "len"), F.lit("")), none)
    types = F.array(pick(TYPES, "rec_no"), pick(TYPES, "len"))
    return view(spark, d, "truth").select("rec_no", C.allele_type(ref, F.length(ref), alt("bases", none, none, seq)).alias("plain"), C.allele_type(ref, F.length(ref), symbolic).alias("named"), C.overall_type(types).alias("overall"), C.overall_alias(pick(NAMES, "pos")).alias("alias"))


@register("variant_lengths", _sql("truth", "select rec_no, greatest(r, a, b) as longest, least(greatest(a, r), greatest(b, r)) as shortest, r + case when a<>r then a else 0 end + case when b<>r then b else 0 end as bases, cast(case t when 'Deletion' then -r when 'Complex' then a-r when 'SNP' then null else greatest(a, r) end as bigint) as svlen from (select rec_no, rec_no%6 as r, cast(len%5 as bigint) as a, rec_no%4 as b, " + pick_sql(["Deletion", "Complex", "SNP", "Insertion"], "rec_no//8") + " as t from truth)"))
def variant_lengths(spark, d):
    r, a, b = F.col("rec_no") % 6, F.col("len").cast("long") % 5, F.col("rec_no") % 4
    t = F.array(pick(["Deletion", "Complex", "SNP", "Insertion"], "rec_no div 8"))
    texts = F.array(F.repeat(F.lit("A"), a.cast("int")), F.repeat(F.lit("C"), b.cast("int")))
    rows = view(spark, d, "truth").select("rec_no", r.alias("r"), a.alias("a"), b.alias("b"), t.alias("t"), texts.alias("x"))
    return rows.select("rec_no", C.max_len(F.col("r"), F.array("a", "b")).alias("longest"), C.min_len(F.col("r"), F.array("a", "b")).alias("shortest"), C.variant_bases(F.col("r").cast("int"), F.col("x")).cast("long").alias("bases"), F.try_element_at(C.svlen_list(F.col("t"), F.col("r"), F.array("a")), F.lit(1)).cast("long").alias("svlen"))


@register("variant_spans", _sql("truth", "select rec_no, s, e, cast(pos as bigint) as s0, case when overall_type='Insertion' then pos else e end as e0, case when overall_type='Deletion' then pos+len-1 else pos end as last, s<=pos+3 and pos+3<=e as holds, cast(floor((s+e)/2.0) as bigint) as middle, e-s+1 as size, overall_type in ('Insertion','Deletion') and len<100 as small, overall_type='Deletion' and len<100 as small0 from tiv", TIV))
def variant_spans(spark, d):
    kind, pos, size = F.col("overall_type"), F.col("pos"), F.col("len")
    rows = view(spark, d, "truth").withColumns({"v": C.variant_interval(kind, pos, size), "w": C.variant_interval(kind, pos, size, True)})
    s, e = F.col("v.start"), F.col("v.end")
    return rows.select("rec_no", s.cast("long").alias("s"), e.cast("long").alias("e"), F.col("w.start").cast("long").alias("s0"), F.col("w.end").cast("long").alias("e0"), C.variant_end(kind, pos, size).cast("long").alias("last"), C.contains_point(s, e, pos + 3).alias("holds"), C.center(s, e).cast("long").alias("middle"), C.length(s, e).cast("long").alias("size"), C.is_small(kind, size).alias("small"), C.is_small(kind, size, ignore_insertion_length=True).alias("small0"))


SHORT = ["", "I", "D", "V", "T", "Q"]
_FEATURE = "case {f} when '' then 'SEQ' when 'I' then 'INS' when 'D' then 'DEL' when 'V' then 'INV' when 'T' then 'DUP_TANDEM' else 'UNKNOWN' end"
_LOC = "chr||'-'||case when rec_no%11=0 then '' else cast(pos as varchar) end||'-'||" + pick_sql(SHORT, "len") + "||case when rec_no%2=0 then '-' else '' end"


@register("read_loci", _sql("truth", f"select rec_no, chr, case when rec_no%11=0 then 0 else pos end as loc, {_FEATURE.format(f=pick_sql(SHORT, 'len'))} as feature, case when rec_no%2=0 then '-' else '+' end as direction, replace({_LOC}, '-Q', '-U') as again, abs(case when rec_no%11=0 then 0 else pos end - 5000) <= 3000 and chr='chr1' as near from truth"))
def read_loci(spark, d):
    place = F.when(F.col("rec_no") % 11 == 0, "").otherwise(F.col("pos").cast("string"))
    name = F.concat("chr", F.lit("-"), place, F.lit("-"), pick(SHORT, "len"), F.when(F.col("rec_no") % 2 == 0, "-").otherwise(""))
    rows = view(spark, d, "truth").select("rec_no", C.parse_loc(name).alias("l"))
    return rows.select("rec_no", "l.chr", "l.loc", "l.feature", "l.direction", C.format_loc(F.col("l")).alias("again"), C.is_close(F.col("l.chr"), F.col("l.loc"), F.lit("chr1"), F.lit(5000), 3000).alias("near"))


_NUMBERS = "cast(rec_no%2 as varchar)||':0:'||cast(len as varchar)||':1:2:'||cast(rec_no%5 as varchar)||':3:4'"
_READ = f"{_LOC}||','||chr||'-7-I:'||chr||'-9-::'||chr||'-8-D:'||{_NUMBERS}||':id'||cast(rec_no as varchar)||':L'||cast(rec_no%3 as varchar)||case when rec_no%2=0 then '/1' else '' end"


@register("read_names", _sql("truth", f"select rec_no, cast(2 as bigint) as n1, cast(0 as bigint) as n3, chr as second_chr, cast(rec_no%2 as int) as random1, cast(len as int) as errors1, cast(rec_no%5 as int) as errors2, 'id'||cast(rec_no as varchar) as id, 'L'||cast(rec_no%3 as varchar) as lane, case when rec_no%2=0 then 1 end as mate, replace({_READ}, '-Q', '-U') as again from truth"))
def read_names(spark, d):
    text_ = lambda c: c.cast("string")
    place = F.when(F.col("rec_no") % 11 == 0, "").otherwise(text_(F.col("pos")))
    loc = F.concat("chr", F.lit("-"), place, F.lit("-"), pick(SHORT, "len"), F.when(F.col("rec_no") % 2 == 0, "-").otherwise(""))
    name = F.concat(loc, F.lit(","), "chr", F.lit("-7-I:"), "chr", F.lit("-9-::"), "chr", F.lit("-8-D:"), text_(F.col("rec_no") % 2), F.lit(":0:"), text_(F.col("len")), F.lit(":1:2:"), text_(F.col("rec_no") % 5), F.lit(":3:4:id"), text_(F.col("rec_no")), F.lit(":L"), text_(F.col("rec_no") % 3), F.when(F.col("rec_no") % 2 == 0, "/1").otherwise(""))
    rows = view(spark, d, "truth").select("rec_no", C.parse_read_name(name).alias("r"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("rec_no", size("r.loci1").alias("n1"), size("r.origin1").alias("n3"), F.element_at("r.loci2", 1)["chr"].alias("second_chr"), "r.random1", "r.errors1", "r.errors2", F.col("r.read_id").alias("id"), "r.lane", "r.mate", C.format_read_name(F.col("r")).alias("again"))


CIGARS = ["50M", "5S40M5S", "3H2S10M", "10=5X", "*", "4S"]


@register("cigars", _sql("truth", f"select rec_no, cast(pos - coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(c, '^((?:[0-9]+[SH])*)', 1), '([0-9]+)[SH]', 1), lambda x: cast(x as bigint))), 0) as bigint) as unclipped, round(coalesce(list_sum(list_transform(regexp_extract_all(c, '([0-9]+)[M=]', 1), lambda x: cast(x as bigint))), 0)::double / nullif(len-1, 0), 9) as same, pos - rec_no%8 as true_start, regexp_replace(alt||chr, '[^ACGTacgt]', 'N', 'g') as masked from (select *, {pick_sql(CIGARS, 'rec_no + len')} as c from truth)"))
def cigars(spark, d):
    c = pick(CIGARS, "rec_no + len")
    return view(spark, d, "truth").select("rec_no", C.unclipped_start(F.col("pos"), c).cast("long").alias("unclipped"), F.round(C.identity(c, F.col("len") - 1), 9).alias("same"), C.unclipped_true_start(F.col("pos"), F.col("rec_no") % 8).alias("true_start"), C.mask_bases(F.concat("alt", "chr")).alias("masked"))


@register("split_somatic", _sql("truth", "select case when rec_no%3=0 then 'somatic' else 'normal' end as part, chr, count(*) as n, cast(sum(rec_no) as bigint) as ids from truth where chr='chr2' group by 1, 2"))
def split_somatic(spark, d):
    rows = setops.on_chr(view(spark, d, "truth"), "chr2").withColumn("id", F.concat(F.when(F.col("rec_no") % 3 == 0, "x,SOMATIC_").when(F.col("rec_no") % 3 == 1, "y").otherwise(F.lit(None)), F.col("rec_no").cast("string")))
    somatic, normal = setops.split_somatic(rows)
    counted = lambda df, part: setops.assert_sorted(df.orderBy("rec_no"), ("pos", "rec_no")).groupBy("chr").agg(F.count("pos").alias("n"), F.sum("rec_no").alias("ids")).select(F.lit(part).alias("part"), "chr", "n", "ids")
    return counted(somatic, "somatic").unionByName(counted(normal, "normal"))


# -- files ---------------------------------------------------------------------------------------------------


def _scanned(spark: SparkSession, d: str, name: str = "truth") -> DataFrame:
    """The truth (or the calls) as variant rows that were written as a VCF and scanned; the record's number is in the id."""
    symbol = F.create_map(*[F.lit(x) for kv in {"Insertion": "<INS>", "Deletion": "<DEL>", "TandemDup": "<DUP:TANDEM>"}.items() for x in kv])[F.col("overall_type")]
    snp = F.col("overall_type") == "SNP"
    ref = F.when(~snp, "N").when(F.col("alt") == "A", "C").otherwise("A")
    size = F.when(F.col("overall_type") == "Deletion", -F.col("len")).otherwise(F.col("len")).cast("string")
    line = F.concat_ws("\t", "chr", F.when(snp, F.col("pos")).otherwise(F.col("pos") - 1).cast("string"), F.col("rec_no").cast("string"), ref, F.when(snp, F.col("alt")).otherwise(symbol), F.lit("."), F.lit("PASS"), F.when(snp, ".").otherwise(F.concat(F.lit("SVLEN="), size)), F.lit("GT"), "gt")
    path = new_path(spark)
    view(spark, d, name).select(line.alias("value")).write.text(path)
    return vcf.read_vcf(spark, path)[0]


@register("vcf_round_trip", _sql("truth", "select rec_no, chr, pos, overall_type, cast(len as int) as size, cast(case gt when '1|1' then 1 else 0 end as int) as gt_p, cast(1 as int) as gt_m, case when overall_type='SNP' then alt end as bases from truth"))
def vcf_round_trip(spark, d):
    path = new_path(spark)
    vcf.write_vcf(_scanned(spark, d), path)
    again = vcf.read_vcf(spark, path)[0]
    return again.select(F.col("id").cast("long").alias("rec_no"), "chr", "pos", "overall_type", F.col("max_len").alias("size"), "gt_p", "gt_m", F.when(F.col("overall_type") == "SNP", F.element_at("alts", 1)["seq"]).alias("bases"))


@register("vcf_rejects", _sql("truth", "select reason, count(*) as n from (select case when rec_no%7=0 then 'no position' when rec_no%7=1 then 'reference genotype' when rec_no%7=2 then 'unknown ALT' when rec_no%7=3 then 'breakend' when rec_no%7=4 then 'SVLEN for another number of ALTs' when rec_no%7=5 then 'REF not ACGTN' else 'used' end as reason from truth) group by reason"))
def vcf_rejects(spark, d):
    k = F.col("rec_no") % 7
    alt = F.when(k == 2, "<XYZ>").when(k == 3, "A[chr2:9[").when(k == 4, "<DEL>").otherwise("C")
    line = F.concat_ws("\t", "chr", F.when(k == 0, "x").otherwise(F.col("pos").cast("string")), F.lit("."), F.when(k == 5, "Q").otherwise("A"), alt, F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.when(k == 1, "0|0").otherwise("0|1"))
    path = new_path(spark)
    view(spark, d, "truth").select(line.alias("value")).write.text(path)
    used, rejects = vcf.read_vcf(spark, path)
    return used.select(F.lit("used").alias("reason")).unionByName(rejects.select(F.col("reject_reason").alias("reason"))).groupBy("reason").count().withColumnRenamed("count", "n")


@register("vcf_statistics", _sql("truth", f"select haplotype, overall_type, cast({_breaks('len')} as int) as bin, count(*) as n, cast(sum(case when len>=100 then 1 else 0 end) as bigint) as n_sv from ({_HAP}) group by 1, 2, 3"))
def vcf_statistics(spark, d):
    return jobs.variant_statistics(_scanned(spark, d))


@register("bed_round_trip", _sql("regions", "select chr, start_pos, end_pos, count(*) as n from regions group by 1, 2, 3"))
def bed_round_trip(spark, d):
    path = new_path(spark)
    sinks.write_bed(view(spark, d, "regions").select("chr", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")), path)
    return text.read_bed(spark, path).groupBy("chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")).agg(F.count("*").alias("n"))


@register("map_round_trip", _sql("map_blocks", "select size, src_chr, src_loc, dst_chr, dst_loc, direction, feature, cast(block_no as varchar) as variant_id from map_blocks"))
def map_round_trip(spark, d):
    path = new_path(spark)
    blocks = view(spark, d, "map_blocks")
    sinks.write_map(blocks.withColumn("variant_id", F.col("block_no").cast("string")), path)
    return text.read_map(spark, path).select("size", "src_chr", "src_loc", "dst_chr", "dst_loc", "direction", "feature", "variant_id")


@register("read_map_round_trip", _sql("truth", "select 'r'||cast(rec_no//16 as varchar) as read_name, cast(rec_no//8%2 as int) as mate, count(*) as blocks, cast(sum(pos) as bigint) as starts, cast(sum(len) as bigint) as ends from truth group by 1, 2"))
def read_map_round_trip(spark, d):
    rows = view(spark, d, "truth").select(F.concat(F.lit("r"), F.expr("rec_no div 16").cast("string")).alias("read_name"), (F.expr("rec_no div 8") % 2).cast("int").alias("mate"), (F.col("rec_no") % 8).alias("block_no"), "chr", F.col("pos").alias("start"), F.col("len").cast("long").alias("end"), F.lit("+").alias("strand"), F.lit("SEQ").alias("feature"), F.lit(0).alias("read_start"), F.lit(9).alias("read_end"))
    path = new_path(spark)
    sinks.write_read_map(rows, path)
    again = text.read_read_map(spark, path)
    # a read that has only its second mate holds it in the first place
    both = rows.groupBy("read_name").agg(F.countDistinct("mate").alias("mates"), F.max("mate").alias("only"))
    joined = again.join(both, "read_name").withColumn("mate", F.when(F.col("mates") == 1, F.col("only")).otherwise(F.col("mate")))
    return joined.groupBy("read_name", F.col("mate").cast("int").alias("mate")).agg(F.count("*").alias("blocks"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@register("sam_scan", _sql("alignments", "select read_name, cast(0 as int) as mate, cast(flags as int) as flags, chr, pos, cast(mapq as int) as mapq, pos-5 as unclipped, 0.5::double as identity from alignments"))
def sam_scan(spark, d):
    rows = view(spark, d, "alignments")
    line = F.concat_ws("\t", "read_name", F.col("flags").cast("string"), F.coalesce("chr", F.lit("*")), F.coalesce(F.col("pos").cast("string"), F.lit("0")), F.col("mapq").cast("string"), F.lit("5S5M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAC"), F.lit("*"))
    path = new_path(spark)
    rows.select(line.alias("value")).write.text(path)
    return text.read_sam(spark, path).select("read_name", "mate", "flags", "chr", "pos", "mapq", "unclipped", "identity")


# -- orders and jobs -----------------------------------------------------------------------------------------

_ORDERS = {
    "vcf": "cast(substr(chr, 4) as int), pos, overall_type, alt",
    "lifted": "chr, pos, overall_type, alt",
    "variants": "chr, pos - len%3, rec_no%4, rec_no",
    "loci": "chr, s, e",
    "files": "rec_no%4, rec_no",
}
_KEYS = {"vcf": "chr||':'||cast(pos as varchar)||overall_type||alt", "lifted": "chr||':'||cast(pos as varchar)||overall_type||alt", "variants": "cast(rec_no as varchar)", "loci": "chr||':'||cast(s as varchar)||'-'||cast(e as varchar)", "files": "cast(rec_no as varchar)"}


@register("file_orders", _sql("truth", " union all ".join(f"select '{n}' as kind, {_KEYS[n]} as row_key, row_number() over (order by {by}) - 1 as place from {'(select distinct chr, pos, overall_type, alt from truth)' if n == 'lifted' else 'tiv'}" for n, by in _ORDERS.items()), TIV))
def file_orders(spark, d):
    start, end = C.interval_ends(F.col("overall_type"), F.col("pos"), F.col("len"))
    rows = view(spark, d, "truth").select("rec_no", "chr", "pos", F.col("overall_type").alias("ref"), "alt", (F.col("rec_no") % 4).alias("file_no"), start.alias("start"), end.alias("end"), F.repeat(F.lit("A"), (F.col("len") % 3).cast("int")).alias("ref_deleted"))
    allele = F.concat("chr", F.lit(":"), F.col("pos").cast("string"), "ref", "alt")
    record, locus = F.col("rec_no").cast("string"), F.concat("chr", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    each = (("vcf", setops.order_vcf, allele), ("lifted", setops.order_lifted, allele), ("variants", setops.order_variants, record), ("loci", setops.order_loci, locus), ("files", setops.file_order, record))
    frames = [numbered(stored(placed(order(rows).select(F.lit(n).alias("kind"), key.alias("row_key")))), "place") for n, order, key in each]
    return setops.union_all(*frames).select("kind", "row_key", "place")


@register("partial_calls", _sql("truth calls", "select c.rec_no, case when bad is null or bad then 'FP' else 'TP' end as outcome from calls c left join (select c_rec_no, bool_or(rec_no//8%4=0) as bad from pairs group by c_rec_no) p on p.c_rec_no=c.rec_no", TIV, CIV, PAIRS))
def partial_calls(spark, d):
    """Every fourth order's truth is taken to be missed."""
    pairs = stored(_pairs(spark, d).select(F.col("c_rec_no").alias("call"), F.col("rec_no").alias("truth")))
    calls = view(spark, d, "calls").select("rec_no")
    hit = calls.join(pairs.select(F.col("call").alias("rec_no")).distinct().withColumn("hit", F.lit(True)), "rec_no", "left").select("rec_no", F.when(F.col("hit"), "TP").otherwise("FP").alias("outcome"))
    missed = pairs.filter(F.expr("truth div 8") % 4 == 0).select("truth")
    return match.disallow_partial_fp(hit, pairs, missed).select("rec_no", "outcome")


@register("alignment_job", _sql("alignments", f"select cast(c as int) as cutoff, {_LADDER} from (select unnest(range(0, 256)) as c) g join status s on s.mapq>=g.c group by c", _STATUS))
def alignment_job(spark, d):
    """Reads against a read map, through the whole job."""
    rows = view(spark, d, "alignments").withColumn("mate", F.lit(0))
    block = F.when(F.col("feature") == "Insertion", "INS").when(F.col("feature") == "Deletion", "DEL").when(F.col("feature") == "TandemDup", "DUP_TANDEM").otherwise("SEQ")
    known = rows.select("read_name", "mate", F.lit(0).alias("block_no"), F.col("true_chr").alias("chr"), (F.col("true_pos") + 3).alias("start"), F.lit(3).cast("long").alias("read_start"), block.alias("feature"))
    reads = rows.select("read_name", "mate", "flags", "chr", "pos", "mapq", "identity")
    return jobs.compare_alignments(reads, jobs.loci_from_read_map(known))["by_mapq"]
