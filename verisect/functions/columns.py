"""Column expressions on variants, alleles, intervals, read names and text fields.

A variant row has the columns of ``verisect.sources.vcf.SCHEMA``; an interval is a pair of closed, 1-based
positions. Nothing here runs Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names and their aliases.
ALLELE_TYPES = ("Reference", "SNP", "Insertion", "Deletion", "MNP", "Inversion", "Tandem_Duplication", "Translocation_Duplication", "Translocation_Deletion", "Complex", "Breakend", "Interspersed_Duplication", "Composite")
OVERALL_TYPES = ("Reference", "SNP", "Deletion", "Insertion", "Inversion", "TandemDup", "Complex", "TransDup", "TransDel", "InterDup", "Translocation")
OVERALL_ALIASES = {"DEL": "Deletion", "INS": "Insertion", "SNP": "SNP", "REF": "Reference", "INV": "Inversion", "ISP_DUP": "InterDup", "TD_DUP": "TandemDup", "TRA_DUP": "TransDup", "TRA_DEL": "TransDel", "CUT_PASTE_TRANS": "Translocation", "CLPX": "Complex"}
SV_MAJOR = ("DEL", "INS", "DUP", "INV", "CNV", "BND")
SV_MINOR = ("TANDEM", "ME", "TRA", "ISP")
#: Allele types that name the overall type; all others are Complex.
OVERALL_OF = {"SNP": "SNP", "Inversion": "Inversion", "Tandem_Duplication": "TandemDup", "Deletion": "Deletion", "Insertion": "Insertion", "Translocation_Deletion": "TransDel", "Translocation_Duplication": "TransDup", "Interspersed_Duplication": "InterDup"}
BLOCK_TYPES = {
    "": "SEQ", "SEQ": "SEQ", "S": "SEQ", "Sequence": "SEQ", "INS": "INS", "I": "INS", "Insertion": "INS", "DEL": "DEL", "D": "DEL", "Deletion": "DEL",
    "INV": "INV", "V": "INV", "Inversion": "INV", "DUP_TANDEM": "DUP_TANDEM", "T": "DUP_TANDEM", "Tandem_Duplication": "DUP_TANDEM",
}
MAPPABLE_BLOCKS = ("SEQ", "INV", "DUP_TANDEM")
DGV_TYPES = {
    "gain": "Tandem_Duplication", "loss": "Deletion", "cnv": "Tandem_Duplication", "duplication": "Tandem_Duplication", "insertion": "Insertion", "mobile element insertion": "Insertion",
    "novel sequence insertion": "Insertion", "deletion": "Deletion", "tandem duplication": "Tandem_Duplication", "inversion": "Inversion",
}
SIZE_BREAKS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 19, 29, 39, 49, 99, 199, 399, 799, 1599, 3199, 6399, 12799, 25599, 51199, 102399, 500000, 1000000)
SV_LENGTH = 100
UNBOUNDED = 2**31 - 1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def alias_of(value: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The canonical name of an alias, by a literal map."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def block_type(value: Column) -> Column:
    """Block type from a long or short name; anything else is UNKNOWN."""
    return alias_of(value, BLOCK_TYPES, "UNKNOWN")


# -- chromosomes -----------------------------------------------------------------------------------------


def strip_chr(chr: Column) -> Column:
    """Without a chr prefix; M is MT."""
    bare = F.regexp_replace(chr, "^(?i:chr)", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def is_x(chr: Column) -> Column:
    return strip_chr(chr).rlike("^X(_|$)")


def is_y(chr: Column) -> Column:
    return strip_chr(chr).rlike("^Y(_|$)")


def is_mt(chr: Column) -> Column:
    return strip_chr(chr).rlike("^MT?(_|$)")


def is_haploid(chr: Column, male: bool) -> Column:
    """Y and MT always, X for a male."""
    alone = is_y(chr) | is_mt(chr)
    return alone | is_x(chr) if male else alone


def natural_key(chr: Column) -> Column:
    """Orders chromosome names by their numbers: runs of digits are padded with zeros."""
    return F.regexp_replace(F.regexp_replace(chr, r"(\d+)", "000000000$1"), r"0*(\d{9})", "$1")


# -- genotypes and FORMAT ----------------------------------------------------------------------------------


def format_index(fmt: Column, key: str) -> Column:
    """Place of a key in a colon-separated FORMAT, from 0; -1 if absent."""
    return F.coalesce(F.array_position(F.split(fmt, ":"), key) - 1, F.lit(-1)).cast("int")


def format_value(fmt: Column, sample: Column, key: str) -> Column:
    """The sample's value of a FORMAT key, null if absent. The key in front, and one that isn't there, take no split."""
    at = F.array_position(F.split(fmt, ":"), key)
    any_place = F.when(at > 0, F.try_element_at(F.split(sample, ":"), F.when(at > 0, at.cast("int")).otherwise(1)))
    return F.when((fmt == key) | fmt.startswith(f"{key}:"), F.substring_index(sample, ":", 1)).when(fmt.contains(key), any_place)


def parse_gt(gt: Column, chr: Column) -> Column:
    """struct(p, m, phased). One allele alone is the mother's on X and MT, the father's on Y, and both
    elsewhere; half-missing genotypes are -1, -1."""
    parts = F.split(gt, r"[/|]")
    first = F.try_element_at(parts, F.lit(1)).try_cast("int")
    second = F.try_element_at(parts, F.lit(2)).try_cast("int")
    alone = F.size(parts) == 1
    missing = F.lit(-1)
    p = F.when(gt.isNull(), missing).when(alone, F.when(is_x(chr) | is_mt(chr), missing).otherwise(F.coalesce(first, missing)))
    m = F.when(gt.isNull(), missing).when(alone, F.when(is_y(chr), missing).otherwise(F.coalesce(first, missing)))
    both = first.isNotNull() & second.isNotNull()
    made = lambda x, y, phased: F.struct(x.cast("int").alias("p"), y.cast("int").alias("m"), phased.alias("phased"))
    phased = F.coalesce(gt.contains("|"), F.lit(False))
    # two digits, and no text at all, are told without splits; a plain struct would be worked out again for each use of a field
    pair = made(F.substr(gt, F.lit(1), F.lit(1)), F.substr(gt, F.lit(3), F.lit(1)), phased)
    none = made(missing, missing, F.lit(False))
    return F.when(gt.isNull(), none).when(gt.rlike("^[0-9][/|][0-9]$"), pair).otherwise(made(p.when(both, first).otherwise(missing), m.when(both, second).otherwise(missing), phased))


def effective_alleles(gt_p: Column, gt_m: Column, n_alts: Column, chr: Column, male: bool = True) -> Column:
    """struct(p, m): what stands for missing alleles: 1 and min(2, n_alts), and -1 for the haplotype that
    a sex chromosome or MT lacks."""
    p = F.when(is_mt(chr) | (is_x(chr) & F.lit(male)), F.lit(-1)).otherwise(F.lit(1))
    m = F.when(is_y(chr), F.lit(-1)).otherwise(F.least(F.lit(2), n_alts))
    return F.struct(F.when(gt_p >= 0, gt_p).otherwise(p).cast("int").alias("p"), F.when(gt_m >= 0, gt_m).otherwise(m).cast("int").alias("m"))


def is_nonref(gt_p: Column, gt_m: Column) -> Column:
    return ~((gt_p == 0) & (gt_m == 0))


def is_hom(gt_p: Column, gt_m: Column) -> Column:
    """Missing alleles are never homozygous."""
    return (gt_p == gt_m) & (gt_p > 0)


def pass_only(flt: Column) -> Column:
    return flt.contains("PASS") | (flt == ".")


def convert_cn(cn: Column, gt: Column | None = None) -> Column:
    """a/b becomes the larger; with gt, a single number becomes one per haplotype (1 where the allele is 0)."""
    parts = F.transform(F.split(cn, r"[/|]"), lambda x: x.try_cast("int"))
    if gt is None:
        return F.array_max(parts).cast("string")
    per = F.transform(F.split(gt, r"[/|]"), lambda g: F.when(g.try_cast("int") == 0, F.lit("1")).otherwise(cn))
    return F.when(F.size(parts) > 1, cn).otherwise(F.array_join(per, "|"))


def allele_fraction(ad: Column, ao: Column, ro: Column) -> Column:
    """Comma-separated fractions of alternative reads: from AD, else AO and RO; 0.0 at depth 0, N/A if both
    are missing."""
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    part = lambda x, t: F.when(t > 0, F.round(x / F.when(t > 0, t), 4)).otherwise(0.0).cast("string")
    from_ad = F.array_join(F.transform(F.filter(numbers(ad), lambda x, i: i >= 1), lambda x: part(x, total(numbers(ad)))), ",")
    depth = total(numbers(ao)) + F.coalesce(ro.try_cast("double"), F.lit(0.0))
    from_ao = F.array_join(F.transform(numbers(ao), lambda x: part(x, depth)), ",")
    return F.when(ad.contains(","), from_ad).when(ao.isNotNull() & ro.isNotNull(), from_ao).otherwise("N/A")


# -- INFO ----------------------------------------------------------------------------------------------------


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used, also within functions of arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_of_keys(fields: Column, key) -> Column:
    """Those of an array's elements whose key no earlier one has."""
    first = lambda fs, ks: F.filter(fs, lambda f, i: F.array_position(ks, key(f)) == i + 1)
    return _bound(fields, lambda fs: _bound(F.transform(fs, key), lambda ks: first(fs, ks)))


def parse_info(info: Column) -> Column:
    """map<string,string>; keys without a value are 'true', the first of repeated keys stays."""
    key = lambda f: F.substring_index(f, "=", 1)
    value = lambda f: F.when(f.contains("="), F.substr(f, F.length(key(f)) + 2)).otherwise("true")
    fields = F.filter(F.split(info, ";"), lambda f: (f != "") & (f != "."))
    keyed = F.transform(fields, lambda f: F.struct(key(f).alias("key"), value(f).alias("value")))
    none, alone = F.create_map().cast("map<string,string>"), F.create_map(key(info), value(info))
    return F.when(info.isin("", "."), none).when(~info.contains(";"), alone).otherwise(F.map_from_entries(_first_of_keys(keyed, lambda kv: kv["key"])))


def info_ints(info: Column, key: str) -> Column:
    """array<long> of a comma-separated INFO value; null if absent."""
    return F.transform(F.split(F.try_element_at(info, F.lit(key)), ","), lambda x: x.try_cast("long"))


def dedupe_info(info: Column) -> Column:
    """INFO text with only the first field of each key."""
    return F.array_join(_first_of_keys(F.split(info, ";"), lambda f: F.substring_index(f, "=", 1)), ";")


# -- alleles -------------------------------------------------------------------------------------------------

_SYMBOLIC = r"^<([A-Za-z]+)(?::([A-Za-z]+))?(?::[^>]*)?>$"
_BREAKEND = r"^([ACGTNacgtn.]*)([\[\]])([^:\[\]]+):(\d+)[\[\]]([ACGTNacgtn.]*)$"


def classify_alt(alt: Column) -> Column:
    """symbolic, breakend, bases, or null for text that is none of them."""
    named = F.regexp_extract(alt, _SYMBOLIC, 1).isin(*SV_MAJOR) & F.regexp_extract(alt, _SYMBOLIC, 2).isin("", *SV_MINOR)
    return F.when(named, "symbolic").when(alt.rlike(_BREAKEND), "breakend").when(is_acgtn(alt), "bases")


def symbolic_parts(alt: Column) -> Column:
    """struct(major, minor), null where the allele isn't symbolic."""
    part = lambda i: F.when(alt.rlike(_SYMBOLIC), F.nullif(F.regexp_extract(alt, _SYMBOLIC, i), F.lit("")))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


def parse_breakend(alt: Column) -> Column:
    """struct(bases, chr, pos, left, forward). left: the bases stand left of the mate, as in A[1:99[;
    forward: the brackets open to the right."""
    g = lambda i: F.regexp_extract(alt, _BREAKEND, i)
    left = g(1) != ""
    return F.when(alt.rlike(_BREAKEND), F.struct(F.when(left, g(1)).otherwise(g(5)).alias("bases"), g(3).alias("chr"), g(4).cast("long").alias("pos"), left.alias("left"), (g(2) == "[").alias("forward")))


def format_breakend(b: Column) -> Column:
    bracket = F.when(b["forward"], "[").otherwise("]")
    place = F.concat(bracket, b["chr"], F.lit(":"), b["pos"].cast("string"), bracket)
    return F.when(b["left"], F.concat(b["bases"], place)).otherwise(F.concat(place, b["bases"]))


def is_acgtn(s: Column) -> Column:
    return s.rlike("^[ACGTNacgtn]+$")


def allele_type(ref: Column, ref_len: Column, alt: Column, has_pos2: Column | bool = False) -> Column:
    """Type of an allele from REF and an alt struct (kind, sv_major, sv_minor, seq, alt_len)."""
    major, minor, size = alt["sv_major"], alt["sv_minor"], alt["alt_len"]
    symbolic = (
        F.when(minor == "TRA", F.when(major == "DUP", "Translocation_Duplication").otherwise("Translocation_Deletion"))
        .when(major == "INS", "Insertion")
        .when(major == "DEL", "Deletion")
        .when(major == "INV", "Inversion")
        .when((major == "DUP") & ((minor == "ISP") | (minor.isNull() & F.lit(has_pos2))), "Interspersed_Duplication")
        .when((major == "DUP") & (minor.isNull() | (minor == "TANDEM")), "Tandem_Duplication")
        .otherwise("Complex")
    )
    plain = (
        F.when((size == 0) & (ref_len == 0), "Reference")
        .when((size == 1) & (ref_len == 1), "SNP")
        .when(size == 0, "Deletion")
        .when((ref_len > size) & ref.endswith(alt["seq"]), "Deletion")
        .when(ref_len == 0, "Insertion")
        .when(ref_len == size, "MNP")
        .otherwise("Complex")
    )
    return F.when(alt["kind"] == "breakend", "Breakend").when(alt["kind"] == "symbolic", symbolic).otherwise(plain)


def overall_type(types: Column) -> Column:
    """Overall type of the allele types, reference left out: one type names itself, several are Complex;
    both translocation types are a Translocation."""
    seen = F.array_distinct(F.filter(types, lambda t: t != "Reference"))
    one = alias_of(F.try_element_at(seen, F.lit(1)), OVERALL_OF, "Complex")
    moved = F.array_contains(seen, "Translocation_Duplication") & F.array_contains(seen, "Translocation_Deletion")
    return F.when(F.size(seen) == 0, "Reference").when(F.size(seen) == 1, one).when(moved, "Translocation").otherwise("Complex")


def overall_type_of(p: Column, m: Column) -> Column:
    """overall_type of the types of two haplotypes, without an array."""
    a, b = F.nullif(p, F.lit("Reference")), F.nullif(m, F.lit("Reference"))
    one = F.coalesce(a, b)
    moved = [x.isin("Translocation_Duplication", "Translocation_Deletion") for x in (a, b)]
    return F.when(one.isNull(), "Reference").when(a.isNull() | b.isNull() | (a == b), alias_of(one, OVERALL_OF, "Complex")).when(moved[0] & moved[1], "Translocation").otherwise("Complex")


def overall_alias(value: Column) -> Column:
    """Overall type from its name in any case, or a short name."""
    return alias_of(F.upper(value), {**{t.upper(): t for t in OVERALL_TYPES}, **OVERALL_ALIASES})


def prefix_length(texts: Column) -> Column:
    """Length of the longest common prefix of an array of strings."""
    shortest = F.aggregate(texts, F.lit(UNBOUNDED), lambda a, x: F.least(a, F.length(x)))
    first = F.element_at(texts, 1)
    # the first place at which some text differs ends the prefix
    differs = F.filter(F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>")), lambda i: F.exists(texts, lambda t: F.substr(t, i, F.lit(1)) != F.substr(first, i, F.lit(1))))
    return F.coalesce(F.array_min(differs) - 1, shortest).cast("int")


def trim_prefix(ref: Column, alts: Column) -> Column:
    """struct(shift, deleted, ref, alts): the prefix that REF and all ALTs share is cut; deleted is the last
    base that went."""
    n = prefix_length(F.concat(F.array(ref), alts))
    return F.struct(n.alias("shift"), F.substr(ref, n, F.least(n, F.lit(1))).alias("deleted"), F.substr(ref, n + 1).alias("ref"), F.transform(alts, lambda a: F.substr(a, n + 1)).alias("alts"))


def clip_suffix(ref: Column, alts: Column) -> Column:
    """struct(ref, alts, clipped): the common suffix of REF and all ALTs is cut, after trim_prefix."""
    n = prefix_length(F.transform(F.concat(F.array(ref), alts), lambda x: F.reverse(x)))
    cut = lambda s: F.substr(s, F.lit(1), F.length(s) - n)
    return F.struct(cut(ref).alias("ref"), F.transform(alts, cut).alias("alts"), F.substr(ref, F.length(ref) - n + 1).alias("clipped"))


def max_len(ref_len: Column, alt_lens: Column) -> Column:
    return F.greatest(ref_len, F.coalesce(F.array_max(alt_lens), F.lit(0)))


def min_len(ref_len: Column, alt_lens: Column) -> Column:
    """The smallest of the alleles' larger lengths."""
    return F.coalesce(F.array_min(F.transform(alt_lens, lambda a: F.greatest(a, ref_len))), ref_len)


def variant_bases(ref_len: Column, alts: Column) -> Column:
    """Reference length and the length of each ALT that is of another length."""
    return ref_len + F.aggregate(alts, F.lit(0), lambda n, a: n + F.when(F.length(a) != ref_len, F.length(a)).otherwise(0))


def svlen(kind: Column, ref_len: Column, alt_len: Column) -> Column:
    """SVLEN of an allele: minus the length for what is deleted; null for SNPs and MNPs."""
    return F.when(kind.isin("Deletion", "Translocation_Deletion"), -ref_len).when(kind == "Complex", alt_len - ref_len).when(kind.isin("SNP", "MNP"), None).otherwise(F.greatest(alt_len, ref_len))


def svlen_list(types: Column, ref_len: Column, alt_lens: Column) -> Column:
    """SVLEN per allele; nothing for SNPs and MNPs."""
    pairs = F.arrays_zip(types.alias("t"), alt_lens.alias("n"))
    return F.filter(F.transform(pairs, lambda x: svlen(x["t"], ref_len, x["n"])), lambda x: x.isNotNull())


# -- intervals -----------------------------------------------------------------------------------------------


def variant_interval(kind: Column, pos: Column, size: Column, ignore_insertion_length: bool = False) -> Column:
    """struct(start, end): an insertion is centred on its place, others run from it; a length that isn't
    known makes all but an insertion one base."""
    start, end = interval_ends(kind, pos, size, ignore_insertion_length)
    return F.struct(start.alias("start"), end.alias("end"))


def interval_ends(kind: Column, pos: Column, size: Column, ignore_insertion_length: bool = False) -> tuple[Column, Column]:
    """Start and end of variant_interval as two plain columns."""
    inserted, half = kind == "Insertion", size.cast("double") / 2
    last = F.when(size >= UNBOUNDED, pos).otherwise(pos + size - 1)
    if ignore_insertion_length:
        return pos, F.when(inserted, pos).otherwise(last)
    return F.when(inserted, (pos - half).cast("long")).otherwise(pos), F.when(inserted, (pos + half - 1).cast("long")).otherwise(last)


def variant_end(kind: Column, pos: Column, size: Column) -> Column:
    return F.when(kind.isin("Insertion", "SNP", "TandemDup", "InterDup", "TransDup"), pos).otherwise(pos + size - 1)


def ref_span(pos: Column, ref_len: Column) -> Column:
    return F.struct(pos.alias("start"), (pos + ref_len - 1).alias("end"))


def is_small(kind: Column, size: Column, limit: int = SV_LENGTH, ignore_insertion_length: bool = False) -> Column:
    kinds = ("Deletion", "Complex") if ignore_insertion_length else ("Insertion", "Deletion", "Complex")
    return kind.isin(*kinds) & (size < limit)


def overlap_bases(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.least(r1, r2) - F.greatest(l1, l2) + 1


def overlaps(l1: Column, r1: Column, l2: Column, r2: Column, ratio: float, wiggle: int) -> Column:
    """Reciprocal overlap after a shift by at most wiggle: shared bases are at least ratio of the longer
    one; ratio 0 asks for one base; two empty intervals match at the same place."""
    shift = F.greatest(F.lit(-wiggle), F.least(F.lit(wiggle), l2 - l1))
    shared = overlap_bases(l1 + shift, r1 + shift, l2, r2)
    return shared >= F.greatest(r1 - l1 + 1, r2 - l2 + 1) * max(ratio, 1 / (2**63 - 1))


def contains_point(l: Column, r: Column, x: Column) -> Column:  # noqa: E741
    return (l <= x) & (x <= r)


def center(l: Column, r: Column) -> Column:  # noqa: E741
    return F.floor((l + r) / 2)


def length(l: Column, r: Column) -> Column:  # noqa: E741
    return r - l + 1


def breakend_like(a: Column, b: Column, wiggle: int) -> Column:
    """Same mate chromosome and orientation, mate positions within wiggle."""
    return (a["chr"] == b["chr"]) & (a["left"] == b["left"]) & (a["forward"] == b["forward"]) & (F.abs(a["pos"] - b["pos"]) <= wiggle)


# -- loci and reads -------------------------------------------------------------------------------------------


def parse_loc(s: Column) -> Column:
    """struct(chr, loc, feature, direction) of chr-loc-F[-]; an empty place is 0, an empty feature SEQ."""
    back = s.endswith("-") & (F.size(F.split(s, "-")) > 3)
    parts = F.split(s, "-")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("chr"), F.coalesce(F.nullif(at(2), F.lit("")).try_cast("long"), F.lit(0)).alias("loc"), F.when(at(3) == "", "SEQ").otherwise(block_type(at(3))).alias("feature"), F.when(back, "-").otherwise("+").alias("direction"))


def format_loc(loc: Column) -> Column:
    short = F.create_map(*[F.lit(x) for kv in {"SEQ": "", "INS": "I", "DEL": "D", "INV": "V", "DUP_TANDEM": "T"}.items() for x in kv])
    place = F.when(loc["loc"] == 0, "").otherwise(loc["loc"].cast("string"))
    return F.concat(loc["chr"], F.lit("-"), place, F.lit("-"), F.coalesce(short[loc["feature"]], F.lit("U")), F.when(loc["direction"] == "-", "-").otherwise(""))


def is_close(a_chr: Column, a_loc: Column, b_chr: Column, b_loc: Column, wiggle: int) -> Column:
    return (a_chr == b_chr) & (F.abs(a_loc - b_loc) <= wiggle)


def parse_read_name(name: Column) -> Column:
    """struct of the truth in a simulated read's name: loci of both ends, eight counts, id, lane."""
    parts = F.split(name, "[:/]")
    loci = lambda i: F.transform(F.filter(F.split(F.element_at(parts, i), ","), lambda x: x != ""), parse_loc)
    count = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    names = ("random1", "random2", "errors1", "snps1", "indels1", "errors2", "snps2", "indels2")
    return F.when(
        F.size(parts) >= 14,
        F.struct(loci(1).alias("loci1"), loci(2).alias("loci2"), loci(3).alias("origin1"), loci(4).alias("origin2"), *(count(5 + i).alias(n) for i, n in enumerate(names)), F.try_element_at(parts, F.lit(13)).alias("read_id"), F.try_element_at(parts, F.lit(14)).alias("lane"), F.try_element_at(parts, F.lit(15)).try_cast("int").alias("mate")),
    )


def format_read_name(r: Column) -> Column:
    loci = lambda c: F.array_join(F.transform(c, format_loc), ",")
    numbers = [r[n].cast("string") for n in ("random1", "random2", "errors1", "snps1", "indels1", "errors2", "snps2", "indels2")]
    return F.concat_ws("/", F.concat_ws(":", loci(r["loci1"]), loci(r["loci2"]), loci(r["origin1"]), loci(r["origin2"]), *numbers, r["read_id"], r["lane"]), r["mate"].cast("string"))


def read_id(n: Column) -> Column:
    return F.base64(n.cast("string").cast("binary"))


def unclipped_true_start(start: Column, read_start: Column) -> Column:
    return start - read_start


def unclipped_start(pos: Column, cigar: Column) -> Column:
    """Position minus the bases clipped before it."""
    clips = F.regexp_extract_all(F.regexp_extract(cigar, r"^((?:\d+[SH])*)", 1), F.lit(r"(\d+)[SH]"), 1)
    return pos - F.aggregate(clips, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def identity(cigar: Column, read_len: Column) -> Column:
    """Bases of M and = by the read's length."""
    same = F.regexp_extract_all(cigar, F.lit(r"(\d+)[M=]"), 1)
    return F.when(read_len > 0, F.aggregate(same, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) / F.when(read_len > 0, read_len))


# -- bases ---------------------------------------------------------------------------------------------------


def rev_comp(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def non_n(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[Nn]", ""))


def mask_bases(s: Column) -> Column:
    return F.regexp_replace(s, "[^ACGTacgt]", "N")


# -- metrics and bins ----------------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b))


def metrics(tp: Column, fp: Column, tn: Column, t: Column) -> dict[str, Column]:
    """tpr, fdr, ppv, spc and f1; null where a denominator is 0."""
    tpr, fdr = ratio(tp, t), ratio(fp, fp + tp)
    precision = F.lit(1.0) - fdr
    return {"tpr": tpr, "fdr": fdr, "ppv": ratio(tp, tp + fp), "spc": ratio(tn, tn + fp), "f1": ratio(F.lit(2.0) * precision * tpr, precision + tpr)}


def size_bin(size: Column, breaks: tuple[int, ...] = SIZE_BREAKS) -> Column:
    """Number of the bin, from 0: the first whose upper limit is at least the size."""
    return reduce(lambda n, b: n + (size > b).cast("int"), breaks, F.lit(0)).cast("int")


def bin_label(number: Column, breaks: tuple[int, ...] = SIZE_BREAKS) -> Column:
    """[lower,upper], from 1 to inf."""
    lows, highs = [1, *(b + 1 for b in breaks)], [*breaks, "inf"]
    return F.element_at(F.array(*(F.lit(f"[{lo},{hi}]") for lo, hi in zip(lows, highs, strict=True))), number + 1)


def max_nn(a: Column, b: Column) -> Column:
    return F.greatest(a, b)
