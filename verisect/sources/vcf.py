"""Scan of VCF text into the canonical variant rows, and what becomes of rows that can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.storage import compiled_in_parts, stored
from verisect.sources.text import read_lines

ALT = "struct<alt_idx:int,kind:string,sv_major:string,sv_minor:string,seq:string,alt_len:int,cn:int,bnd_chr:string,bnd_pos:bigint,bnd_left:boolean,bnd_forward:boolean,allele_type:string>"


def parse_lines(lines: DataFrame, sample: str | int | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Columns of VCF data lines (file, rec_no, value): text fields, INFO as a map, genotype.

    sample: a sample's place among the sample columns (from 0), or its name, looked up in samples (file,
    names: array of header columns); the first one by default.
    """
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    at = lambda i: F.try_element_at("f", F.lit(i))
    place: Column = F.lit(10 + (sample if isinstance(sample, int) else 0))
    if isinstance(sample, str):
        if samples is None:
            raise ValueError("a sample's name needs the files' header columns")
        rows = rows.join(F.broadcast(samples), "file", "left")
        place = F.coalesce(F.nullif(F.array_position("names", sample), F.lit(0)), F.lit(10)).cast("int")
    out = rows.select("file", "rec_no", at(1).alias("chr"), at(2).try_cast("long").alias("pos"), at(3).alias("id"), F.upper(at(4)).alias("ref"), F.split(at(5), ",").alias("alt"), at(6).alias("qual"), at(7).alias("filter"), at(8).alias("info_raw"), at(9).alias("format"), F.try_element_at("f", place).alias("sample"))
    gt, cn = C.format_value(F.col("format"), F.col("sample"), "GT"), C.format_value(F.col("format"), F.col("sample"), "CN")
    out = out.withColumns({"info": C.parse_info(F.coalesce("info_raw", F.lit(""))), "gt_text": gt, "cn_text": cn})
    return out.withColumns({"g": C.parse_gt(F.col("gt_text"), F.col("chr")), "c": C.parse_gt(F.col("cn_text"), F.col("chr"))})


def _fields(a: Column, kind: Column, major: Column, minor: Column, bnd: Column, size: Column) -> dict[str, Column]:
    """An alt struct's fields but its place and type; size: its SVLEN."""
    copies, size = F.col("__copies"), F.abs(size).cast("int")
    # an insertion of length 0 has no known bound
    long = F.when(major == "DEL", 0).when((major == "INS") & (size == 0), C.UNBOUNDED).otherwise(size)
    dispersed = minor.isin("TRA", "ISP")
    cn = F.when(major == "DUP", F.when(dispersed, F.greatest(F.when(copies > 0, copies).otherwise(1), F.lit(1))).otherwise(F.when(copies > 0, copies).otherwise(2)))
    return {
        "kind": kind, "sv_major": major, "sv_minor": minor, "seq": F.when(kind == "bases", F.upper(a)), "alt_len": F.when(kind == "symbolic", long).otherwise(F.length(a)).cast("int"), "cn": cn.cast("int"),
        "bnd_chr": bnd["chr"], "bnd_pos": bnd["pos"], "bnd_left": bnd["left"], "bnd_forward": bnd["forward"],
    }


def _minor(sv: Column) -> Column:
    """The minor part of a symbolic allele; that of a duplication without one follows from its INFO."""
    return F.when((sv["major"] == "DUP") & sv["minor"].isNull() & F.map_contains_key("info", "POS2"), F.when(F.map_contains_key("info", "TRAID"), "TRA").otherwise("ISP")).otherwise(sv["minor"])


def _struct(number: Column, fields: dict[str, Column], kind: Column) -> Column:
    return F.struct(number.cast("int").alias("alt_idx"), *(v.alias(k) for k, v in fields.items()), kind.alias("allele_type"))


def _alts(alt: Column) -> Column:
    """The alt structs; lengths of symbolic alleles come from SVLEN, by place."""
    sizes = C.info_ints(F.col("info"), "SVLEN")

    def one(a: Column, i: Column) -> Column:
        sv = C.symbolic_parts(a)
        size = F.try_element_at(sizes, (i + 1).cast("int"))
        return _struct(i + 1, _fields(a, C.classify_alt(a), sv["major"], _minor(sv), C.parse_breakend(a), size), F.lit(None).cast("string"))

    return F.transform(alt, one)


def reject_reason() -> Column:
    """Why a parsed row can't be used; null if it can. Rows with one ALT have it in __a, its kind in __kind."""
    one, kinds = F.col("__one"), F.transform("alts", lambda a: a["kind"])
    majors = F.transform("alts", lambda a: a["sv_major"])
    of = lambda single, several: F.when(one, single).otherwise(several)
    sizes = C.info_ints(F.col("info"), "SVLEN")
    spread = ~one & F.exists(majors, lambda m: m.isin("INV", "DUP", "DEL")) & (F.size(F.array_distinct(F.transform(sizes, lambda x: F.abs(x)))) > 1)
    return (
        F.when(F.col("pos").isNull(), "no position")
        .when((F.col("__gt_p") == 0) & (F.col("__gt_m") == 0), "reference genotype")
        .when(F.col("ref").isNull() | (F.col("ref") == ""), "empty REF")
        .when(~C.is_acgtn(F.col("ref")), "REF not ACGTN")
        .when(of(F.col("__a") == "", F.exists(F.col("alt"), lambda a: a == "")), "empty ALT")
        .when(of(F.col("__kind").isNull(), F.exists(kinds, lambda k: k.isNull())), "unknown ALT")
        .when(of(F.col("__kind") == "breakend", F.array_contains(kinds, "breakend")), "breakend")
        .when(F.col("gt_text").isNotNull() & F.col("cn_text").isNotNull() & (F.size(F.split("gt_text", r"[/|]")) > 1) & F.col("cn_text").rlike(r"[/|]") & (F.col("__phased") != F.col("c.phased")), "CN and GT phased differently")
        .when(F.col("__symbolic") & (F.coalesce(F.size("__sizes"), F.lit(0)) != F.size("alt")), "SVLEN for another number of ALTs")
        .when(F.col("__symbolic") & F.coalesce(spread, F.lit(False)), "unequal SVLENs")
    )


def normalise(parsed: DataFrame) -> DataFrame:
    """Canonical variant rows of parsed lines, with reject_reason.

    Most lines have one ALT. What is asked of it are columns of their own (__a and those after it), which Spark compiles
    and works out once; functions of arrays are interpreted, and are left for several ALTs and for common prefixes of
    longer texts.
    """
    one = F.coalesce(F.size("alt") == 1, F.lit(False))
    rows = parsed.withColumns({"__one": one, "__a": F.when(one, F.try_element_at("alt", F.lit(1))), "__sizes": F.split(F.try_element_at("info", F.lit("SVLEN")), ","), "__copies": F.greatest("c.p", "c.m"), "__gt_p": F.col("g.p"), "__gt_m": F.col("g.m"), "__phased": F.col("g.phased")})
    single = F.col("__a")
    part = lambda name: C.symbolic_parts(single)[name]
    rows = rows.withColumns({"alts": _alts(F.when(~F.col("__one"), F.col("alt"))), "__size": F.try_element_at("__sizes", F.lit(1)).try_cast("long"), "__kind": C.classify_alt(single), "__sv": F.when(single.startswith("<"), F.struct(part("major").alias("major"), part("minor").alias("minor"))), "__bnd": C.parse_breakend(single)})
    rows = rows.withColumns({"__minor": _minor(F.col("__sv")), "__symbolic": F.when(F.col("__one"), F.col("__kind") == "symbolic").otherwise(F.exists("alts", lambda a: a["kind"] == "symbolic"))})
    rows = rows.withColumn("reject_reason", reject_reason())
    rows = rows.withColumns({"__plain": F.coalesce(~F.col("__symbolic") & F.col("reject_reason").isNull(), F.lit(False)), "__seq": F.upper(single)})
    plain, short = F.col("__plain"), F.col("__short")
    # of two texts, one of them of one base, at most that base is shared at either end
    rows = rows.withColumn("__short", plain & F.col("__one") & F.coalesce(F.least(F.length("ref"), F.length("__seq")) <= 1, F.lit(False)))
    seqs = F.when(F.col("__one"), F.array(F.coalesce("__seq", F.lit("")))).otherwise(F.transform("alts", lambda a: F.coalesce(a["seq"], F.lit(""))))
    same = lambda x, y: F.when(x == y, 1).otherwise(0)
    rows = rows.withColumns({"t": F.when(plain & ~short, C.trim_prefix(F.col("ref"), seqs)), "__n": F.when(short, same(F.substr("ref", F.lit(1), F.lit(1)), F.substr("__seq", F.lit(1), F.lit(1))))})
    rows = rows.withColumns({"s": F.when(F.col("t").isNotNull(), C.clip_suffix(F.col("t.ref"), F.col("t.alts"))), "__r": F.when(short, F.substr("ref", F.col("__n") + 1)), "__x": F.when(short, F.substr("__seq", F.col("__n") + 1))})
    last = lambda c: F.substr(c, F.length(c), F.lit(1))
    rows = rows.withColumn("__k", F.when(short, F.when(F.least(F.length("__r"), F.length("__x")) == 0, 0).otherwise(same(last(F.col("__r")), last(F.col("__x"))))))
    cut = lambda c: F.substr(c, F.lit(1), F.length(c) - F.col("__k"))
    rows = rows.withColumns({
        "__ref": F.when(short, cut(F.col("__r"))).when(plain, F.col("s.ref")).otherwise(F.lit("")),
        "__alt": F.when(short, cut(F.col("__x"))).when(plain & F.col("__one"), F.try_element_at("s.alts", F.lit(1))),
    })
    first = F.try_element_at("alts", F.lit(1))
    major, minor = F.when(F.col("__one"), F.col("__sv.major")).otherwise(first["sv_major"]), F.when(F.col("__one"), F.col("__minor")).otherwise(first["sv_minor"])
    size = F.abs(F.col("__size")).cast("int")
    ref_len = F.when(plain, F.length("__ref")).when(major.isin("INV", "DUP", "DEL"), F.when((major == "DUP") & minor.isin("TRA", "ISP"), 0).otherwise(size)).when(major == "INS", 0).otherwise(F.length("ref"))
    fields = _fields(single, F.col("__kind"), F.col("__sv.major"), F.col("__minor"), F.col("__bnd"), F.col("__size"))
    with_seq = F.transform("alts", lambda a, i: a.withField("seq", F.when(plain, F.element_at("s.alts", i + 1)).otherwise(a["seq"])).withField("alt_len", F.when(plain, F.length(F.element_at("s.alts", i + 1))).otherwise(a["alt_len"])))
    rows = rows.withColumns({"ref_len": ref_len.cast("int"), "alts": with_seq, "__len": F.when(plain, F.length("__alt")).otherwise(fields["alt_len"]), "__alt": F.when(plain, F.col("__alt")).otherwise(fields["seq"])})
    typed = lambda a: C.allele_type(F.col("__ref"), F.col("ref_len"), a, F.map_contains_key("info", "POS2"))
    fields = {**fields, "seq": F.col("__alt"), "alt_len": F.col("__len")}
    alone = F.array(_struct(F.lit(1), fields, typed(fields)))
    rows = rows.withColumn("alts", F.when(F.col("__one"), alone).otherwise(F.transform("alts", lambda a: a.withField("allele_type", typed(a)))))
    eff = C.effective_alleles(F.col("__gt_p"), F.col("__gt_m"), F.size("alts"), F.col("chr"))
    rows = rows.withColumns({"__eff_p": eff["p"], "__eff_m": eff["m"]})
    own = lambda g: F.try_element_at("alts", F.when(g > 0, g).otherwise(1))
    of = lambda g: F.when(g > 0, own(g)["allele_type"]).otherwise("Reference")
    size_of = lambda g: F.when(g > 0, F.greatest("ref_len", own(g)["alt_len"])).otherwise(0)
    p, m = F.col("__eff_p"), F.col("__eff_m")
    rows = rows.withColumns({"__type_p": of(p), "__type_m": of(m)})
    return rows.select(
        F.col("file").alias("source"), "rec_no", "chr", F.when(short, F.col("pos") + F.col("__n")).when(plain, F.col("pos") + F.col("t.shift")).otherwise(F.col("pos") + 1).alias("pos"), "id", F.col("__ref").alias("ref"), "ref_len", "alts", F.col("__gt_p").alias("gt_p"), F.col("__gt_m").alias("gt_m"), F.col("__phased").alias("phased"), "filter", "qual", "info", "info_raw",
        F.when(short, F.substr("ref", F.col("__n"), F.col("__n"))).when(plain, F.col("t.deleted")).otherwise(F.col("ref")).alias("ref_deleted"), F.when(short, F.substr("__r", F.length("__r") - F.col("__k") + 1)).when(plain, F.col("s.clipped")).otherwise("").alias("clipped"), F.split(F.try_element_at("info", F.lit("CHR2")), ",").alias("chr2"), C.info_ints(F.col("info"), "POS2").alias("pos2"), C.info_ints(F.col("info"), "END2").alias("end2"),
        F.map_contains_key("info", "ISINV").alias("is_inv"), F.map_contains_key("info", "IMPRECISE_LENGTH").alias("imprecise"), F.try_element_at("info", F.lit("TRAID")).alias("traid"), C.overall_type_of(F.col("__type_p"), F.col("__type_m")).alias("overall_type"), F.greatest(size_of(p), size_of(m)).cast("int").alias("max_len"), "reject_reason", F.col("alt").alias("alt_text"), F.col("cn_text"),
    )


def read_vcf(spark: SparkSession, paths: str | list[str], sample: str | int | None = None, pass_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(variants, rejects) of VCF files, rejects with a reason. Gzip is told by content. The parsed
    rows are written to the shared folder once: text can't be pruned, and file order is fixed there."""
    lines = read_lines(spark, paths)
    names = None
    if isinstance(sample, str):
        header = lines.filter(F.col("value").startswith("#CHROM"))
        names = header.groupBy("file").agg(F.first(F.split("value", "\t")).alias("names"))
    rows = normalise(parse_lines(lines, sample, names))
    if pass_only:
        rows = rows.filter(C.pass_only(F.col("filter")))
    with compiled_in_parts(spark):
        rows = stored(rows)
    return rows.filter("reject_reason is null").drop("reject_reason"), rows.filter("reject_reason is not null")


def clean_variants(parsed: DataFrame) -> DataFrame:
    """Rows of parse_lines with ./. as 0/1, an INFO that repeats a key as '.', and ID, QUAL and FILTER blank."""
    keys = F.transform(F.split("info_raw", ";"), lambda f: F.substring_index(f, "=", 1))
    repeated = F.size(keys) != F.size(F.array_distinct(keys))
    blank = F.lit(".")
    return parsed.filter(F.col("format").isNotNull()).withColumns({"sample": F.regexp_replace("sample", r"^\./\.", "0/1"), "info_raw": F.when(repeated, blank).otherwise(F.col("info_raw")), "id": blank, "qual": blank, "filter": blank})


def select_samples(lines: DataFrame, places: list[int]) -> DataFrame:
    """Data lines with only the sample columns at these places (from 0)."""
    fields = F.split("value", "\t")
    kept = F.concat(F.slice(fields, 1, 9), *(F.slice(fields, 10 + p, 1) for p in places))
    return lines.withColumn("value", F.when(F.col("value").startswith("##"), F.col("value")).otherwise(F.array_join(kept, "\t")))


def get_field(key: str) -> Column:
    """A field of parse_lines rows by name: from the sample's FORMAT, else INFO."""
    return F.coalesce(C.format_value(F.col("format"), F.col("sample"), key), F.try_element_at("info", F.lit(key)))


# -- sink ----------------------------------------------------------------------------------------------------

# The header of a written file.
HEADER = (
    "##fileformat=VCFv4.3",
    '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="Length">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=VARIANT_OVERALL_TYPE,Number=1,Type=String,Description="Overall variant type">',
    '##INFO=<ID=CHR2,Number=.,Type=String,Description="Chromosome of the source of a copy">',
    '##INFO=<ID=POS2,Number=.,Type=Integer,Description="Start of the source of a copy">',
    '##INFO=<ID=END2,Number=.,Type=Integer,Description="End of the source of a copy">',
    '##INFO=<ID=TRAID,Number=1,Type=String,Description="Translocation that a record belongs to">',
    '##INFO=<ID=ISINV,Number=0,Type=Flag,Description="The copy is inverted">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=CN,Number=1,Type=String,Description="Copy number of each haplotype">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample",
)
#: SVTYPE by overall type.
SVTYPES = {"TandemDup": "DUP", "TransDup": "DUP", "InterDup": "DUP", "Deletion": "DEL", "TransDel": "DEL", "Inversion": "INV"}


def _one_or_more(one, several) -> Column:
    """one(alt) of a row with one ALT, which Spark compiles, else several(alts)."""
    return F.when(F.size("alts") == 1, one(F.try_element_at("alts", F.lit(1)))).otherwise(several(F.col("alts")))


def _info() -> Column:
    """INFO of a canonical row: its own fields first, then its type and what the type asks for; of a key that comes
    twice the first one stays."""
    kind = F.col("overall_type")
    field = lambda key, value: F.concat(F.lit(f"{key}="), value)  # noqa: E731  null if the value is
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    copied, moved = kind.isin("TransDup", "InterDup"), kind.isin("TransDup", "InterDup", "TransDel")
    names = F.create_map(*[F.lit(x) for kv in SVTYPES.items() for x in kv])
    own = F.when(~F.coalesce("info_raw", F.lit(".")).isin("", "."), F.col("info_raw"))
    turned = F.when(kind.isin("TandemDup", "TransDup", "InterDup") & F.col("is_inv"), "ISINV")
    more = [F.when(copied, field(k, listed(F.col(c)))) for k, c in (("CHR2", "chr2"), ("POS2", "pos2"), ("END2", "end2"))]
    sizes = lambda alts: C.svlen_list(F.transform(alts, lambda a: a["allele_type"]), F.col("ref_len"), F.transform(alts, lambda a: a["alt_len"]))
    size = _one_or_more(lambda a: C.svlen(a["allele_type"], F.col("ref_len"), a["alt_len"]).cast("string"), lambda alts: listed(sizes(alts)))
    made = F.concat_ws(";", own, field("VARIANT_OVERALL_TYPE", kind), field("SVTYPE", names[kind]), F.when(moved, field("TRAID", F.col("traid"))), field("SVLEN", size), *more, turned)
    return F.when(own.isNull(), made).otherwise(C.dedupe_info(made))


def _sample() -> tuple[Column, Column]:
    """FORMAT and the sample's text: GT, and CN where an allele has several copies. A haplotype that isn't there is left
    out, as haploid text is."""
    p, m = F.col("gt_p"), F.col("gt_m")
    several = lambda a: F.coalesce(a["cn"], F.lit(0)) > 1
    has_cn = _one_or_more(several, lambda alts: F.exists(alts, several))
    sep = F.when(F.col("phased") | (p == m), "|").otherwise("/")
    pair = lambda x, y: F.when((p >= 0) & (m >= 0), F.concat(x, sep, y)).when(p >= 0, x).when(m >= 0, y)
    copies = lambda g: F.coalesce(F.try_element_at("alts", F.when(g > 0, g))["cn"], F.lit(1)).cast("string")
    gt = F.coalesce(pair(p.cast("string"), m.cast("string")), F.lit("./."))
    cn = F.coalesce(pair(copies(p), copies(m)), F.lit("./."))
    return F.when(has_cn, "GT:CN").otherwise("GT"), F.when(has_cn, F.concat_ws(":", gt, cn)).otherwise(gt)


def format_vcf_line() -> Column:
    """A data line of a canonical row: trimmed bases come back, INFO says what the type asks for, CN is kept."""
    any_of = lambda test: _one_or_more(test, lambda alts: F.exists(alts, test))
    symbolic = any_of(lambda a: a["kind"] == "symbolic")
    padded = (F.col("ref") == "") | any_of(lambda a: a["seq"] == "")
    pad, tail = F.when(padded, F.col("ref_deleted")).otherwise(""), F.coalesce("clipped", F.lit(""))
    ref = F.when(symbolic, F.col("ref_deleted")).otherwise(F.concat(pad, F.col("ref"), tail))
    name = lambda a: F.concat(F.lit("<"), a["sv_major"], F.coalesce(F.concat(F.lit(":"), a["sv_minor"]), F.lit("")), F.lit(">"))
    text = lambda a: F.when(a["kind"] == "symbolic", name(a)).otherwise(F.concat(pad, a["seq"], tail))
    alt = _one_or_more(lambda a: F.coalesce(text(a), F.lit("")), lambda alts: F.array_join(F.transform(alts, text), ","))
    form, sample = _sample()
    pos = F.when(symbolic | padded, F.col("pos") - 1).otherwise(F.col("pos"))
    return F.concat_ws("\t", "chr", pos.cast("string"), "id", ref, alt, F.coalesce("qual", F.lit(".")), F.coalesce("filter", F.lit(".")), _info(), form, sample)


def write_vcf(df: DataFrame, path: str) -> None:
    """Text with the header once, then the rows in file order. Lines are made once and put in order from a table, as
    a sort reads what it sorts twice."""
    spark = df.sparkSession
    head = spark.createDataFrame([(i, h) for i, h in enumerate(HEADER)], "n long, value string").withColumn("part", F.lit(0))
    with compiled_in_parts(spark):
        body = stored(df.select((F.col("rec_no")).alias("n"), format_vcf_line().alias("value"))).withColumn("part", F.lit(1))
    head.unionByName(body).orderBy("part", "n").select("value").write.text(path)


def explode_composites(df: DataFrame) -> DataFrame:
    """A composite (members: array of canonical rows) as one row per member."""
    return df.select("*", F.explode("members").alias("member")).select("member.*")
