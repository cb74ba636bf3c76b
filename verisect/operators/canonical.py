"""Canonical pieces of variants: complex variants and MNPs become one indel and SNPs.

The indel of an allele stands at the left or at the right end of the variant; SNPs are what differs on the
rest. Both ways are worked out as arrays, and the one with fewer pieces is exploded (left wins ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.functions import columns as C

_PIECE = "array<struct<pos:bigint,ref:string,alt:string,alt2:string,gt_p:int,gt_m:int>>"


def _piece(pos: Column, ref: Column, alt: Column, p: Column | int, m: Column | int, alt2: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    none = F.lit(None).cast("string")
    return F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), (alt2 if alt2 is not None else none).alias("alt2"), lit(p).cast("int").alias("gt_p"), lit(m).cast("int").alias("gt_m"))


def _none() -> Column:
    return F.array().cast(_PIECE)


def _indel(pos: Column, ref: Column, alt: Column, p: Column | int, m: Column | int, right: bool, exact: bool = False) -> Column:
    """The indel that makes up the difference in length, as an array of at most one piece. At the right end it takes
    the first bases of ALT too, as at the left, or (exact) the last ones."""
    n, more = F.length(ref), F.length(alt) - F.length(ref)
    kept = F.length(alt) if right else F.lit(0)
    insertion = F.array(_piece(pos + n if right else pos, F.lit(""), F.substr(alt, n + 1 if right and exact else F.lit(1), more), p, m))
    deletion = F.array(_piece(pos + kept, F.substr(ref, kept + 1, -more), F.lit(""), p, m))
    return F.when(more > 0, insertion).when(more < 0, deletion).otherwise(_none())


def _base(ref: Column, alt: Column, i: Column, right: bool) -> Column:
    """The allele's base opposite base i of REF (from 1); null where it is deleted."""
    at = i if right else i + F.length(alt) - F.length(ref)
    return F.when((at >= 1) & (at <= F.length(alt)), F.substr(alt, at, F.lit(1)))


def _places(ref: Column) -> Column:
    return F.when(F.length(ref) > 0, F.sequence(F.lit(1), F.length(ref))).otherwise(F.array().cast("array<int>"))


def _one_allele(pos: Column, ref: Column, alt: Column, p: Column | int, m: Column | int, right: bool, exact: bool = False) -> Column:
    def snp(i: Column) -> Column:
        base, own = _base(ref, alt, i, right), F.substr(ref, i, F.lit(1))
        return F.when(base != own, _piece(pos + i - 1, own, base, p, m))

    return F.concat(_indel(pos, ref, alt, p, m, right, exact), F.array_compact(F.transform(_places(ref), snp)))


def _two_alleles(pos: Column, ref: Column, a: Column, b: Column, right: bool, exact: bool = False) -> Column:
    """Both alleles differ from REF; what they share is one homozygous piece."""
    more_a, more_b = F.length(a) - F.length(ref), F.length(b) - F.length(ref)
    same = (more_a == more_b) & ((more_a < 0) | (a == b))
    indel = lambda x, p, m: _indel(pos, ref, x, p, m, right, exact)
    indels = F.when(same, indel(a, 1, 1)).otherwise(F.concat(indel(a, 1, 0), indel(b, 0, 1)))

    def snps(i: Column) -> Column:
        own, x, y = F.substr(ref, i, F.lit(1)), _base(ref, a, i, right), _base(ref, b, i, right)
        at = pos + i - 1
        only = F.coalesce(x, y)  # where one allele is deleted, the other stands alone
        return (
            F.when(x.isNull() & y.isNull(), None)
            .when(x.isNull() | y.isNull() | (x == y), F.when(only != own, _piece(at, own, only, 1, 1)))
            .when((x != own) & (y != own), _piece(at, own, x, 1, 2, y))
            .when(x != own, _piece(at, own, x, 1, 0))
            .otherwise(_piece(at, own, y, 0, 1))
        )

    return F.concat(indels, F.array_compact(F.transform(_places(ref), snps)))


def canonicalize(variants: DataFrame, carry: tuple[str, ...] = (), exact_right_end: bool = False) -> DataFrame:
    """One row per piece of each variant (rec_no, chr, pos, ref, alts, gt_p, gt_m) of sequence alleles:
    rec_no, piece_no, chr, pos, ref, alt, alt2, gt_p, gt_m, and the variant's columns named in carry. Missing genotypes count as alleles 1 and
    min(2, number of ALTs). exact_right_end: an insertion at the right end has the bases that stand there, not the
    first ones. What each step works out is a column, so that it is worked out once."""
    pos, ref, a, b = F.col("pos"), F.col("ref"), F.col("__p"), F.col("__m")
    eff = C.effective_alleles(F.col("gt_p"), F.col("gt_m"), F.size("alts"), F.col("chr"))
    allele = lambda g: F.when(g > 0, F.try_element_at("alts", F.when(g > 0, g).otherwise(1)))
    rows = variants.select("rec_no", "chr", "pos", "ref", "alts", eff.alias("__g"), *carry).filter("__g.p > 0 or __g.m > 0")
    rows = rows.select("rec_no", "chr", *carry, "pos", "ref", allele(F.col("__g.p")).alias("__p"), allele(F.col("__g.m")).alias("__m"))
    len_or = lambda x: F.coalesce(F.length(x), F.lit(1))
    single = (F.length(ref) == 1) & (len_or(a) == 1) & (len_or(b) == 1)
    snp = F.array(_piece(pos, ref, F.coalesce(a, b), F.when(a.isNotNull(), 1).otherwise(0), F.when(b.isNull(), 0).when(a.isNull() | (a == b), 1).otherwise(2), F.when(a != b, b)))
    # the three kinds are worked out apart: SNPs, variants of both haplotypes, and those of one
    both = a.isNotNull() & b.isNotNull()
    keep = ["rec_no", "chr", *carry]
    out = rows.filter(single).select(*keep, snp.alias("pieces"))

    two = rows.filter(~single & both).withColumn("__n", F.least(C.prefix_length(F.array(ref, a)), C.prefix_length(F.array(ref, b))))
    cut = lambda x: F.substr(x, F.col("__n") + 1)
    two = two.select(*keep, (pos + F.col("__n")).alias("pos"), cut(ref).alias("ref"), cut(a).alias("__p"), cut(b).alias("__m"))
    two = two.select(*keep, *(_two_alleles(pos, ref, a, b, right, exact_right_end).alias(n) for n, right in (("l", False), ("r", True))))

    alt = F.coalesce(a, b)
    p, m = F.when(a.isNotNull(), 1).otherwise(0), F.when(b.isNotNull(), 1).otherwise(0)
    split = (F.length(alt) > 0) & (F.length(ref) > 0)
    whole = F.array(_piece(pos, ref, alt, p, m))
    one = rows.filter(~single & ~both).select(*keep, *(F.when(split, _one_allele(pos, ref, alt, p, m, right, exact_right_end)).otherwise(whole).alias(n) for n, right in (("l", False), ("r", True))))

    best = F.when(F.size("r") < F.size("l"), F.col("r")).otherwise(F.col("l"))
    out = out.unionByName(two.select(*keep, best.alias("pieces"))).unionByName(one.select(*keep, best.alias("pieces")))
    # outer: for the inner kind Spark derives a filter that repeats the whole expression many times over
    each = out.select(*keep, F.posexplode_outer("pieces").alias("piece_no", "x")).filter("x is not null")
    return each.select("rec_no", "piece_no", "chr", "x.*", *carry)


def _haplotypes(gt_p: Column, gt_m: Column, make) -> Column:
    """make(haplotype, p, m) for each haplotype that carries the variant."""
    return F.array_compact(F.array(F.when(gt_p > 0, make("paternal", 1, 0)), F.when(gt_m > 0, make("maternal", 0, 1))))


def dup_to_breakends(dups: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two breakends for each haplotype that carries a dispersed duplication (rec_no, chr, pos, chr2, pos2,
    end2, is_inv, gt_p, gt_m): one into the copy, at the base before pos, and one out of it, at pos; the
    mates are swapped if it is inverted."""

    def ends(hap: str, p: int, m: int) -> Column:
        into, out = F.when(F.col("is_inv"), F.col("end2")).otherwise(F.col("pos2")), F.when(F.col("is_inv"), F.col("pos2")).otherwise(F.col("end2"))
        bnd = lambda mate, left: F.struct((F.col("pos") - 1 if left else F.col("pos")).alias("pos"), F.lit(hap).alias("haplotype"), F.col("chr2").alias("mate_chr"), mate.alias("mate_pos"), F.lit(left).alias("left"), F.when(F.col("is_inv"), not left).otherwise(left).alias("forward"), F.lit(p).alias("gt_p"), F.lit(m).alias("gt_m"))
        return F.array(bnd(into, True), bnd(out, False))

    each = F.flatten(_haplotypes(F.col("gt_p"), F.col("gt_m"), ends))
    return dups.select("rec_no", "chr", *carry, F.posexplode(each).alias("piece_no", "x")).select("rec_no", "piece_no", "chr", "x.*", *carry)


def del_to_breakends(dels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One breakend for each haplotype that carries a translocated deletion (rec_no, chr, pos, ref_len,
    gt_p, gt_m): the base before is joined to the base after."""

    def end(hap: str, p: int, m: int) -> Column:
        return F.struct(F.lit(hap).alias("haplotype"), F.col("chr").alias("mate_chr"), (F.col("pos") + F.col("ref_len")).alias("mate_pos"), F.lit(True).alias("left"), F.lit(True).alias("forward"), F.lit(p).alias("gt_p"), F.lit(m).alias("gt_m"))

    each = _haplotypes(F.col("gt_p"), F.col("gt_m"), end)
    rows = dels.select("rec_no", "chr", (F.col("pos") - 1).alias("pos"), *carry, F.posexplode(each).alias("piece_no", "x"))
    return rows.select("rec_no", "piece_no", "chr", "pos", "x.*", *carry)


def compose_traid(variants: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of composites with the pair's id, and the type that all their alleles have together; pairs
    as of pair_by_traid, variants (rec_no, types: array of allele types)."""
    members = pairs.select("traid", "pair", F.explode("members").alias("rec_no")).join(variants, "rec_no")
    kinds = members.groupBy("traid", "pair").agg(C.overall_type(F.flatten(F.collect_set("types"))).alias("composite_type"))
    return members.join(kinds, ["traid", "pair"])
