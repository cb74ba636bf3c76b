"""One-to-one assignment of calls to truth, and the outcomes that follow.

Edges say which call piece may take which truth piece: (call, call_order, piece, truth, truth_order). In
call order, each piece takes the first truth piece that no earlier call took; pieces of one call don't
compete. Calls that share no truth with an earlier undecided one are decided together, in rounds, and chains of
calls in which each waits for one other are resolved by doubling, so no group is gathered or replayed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import interval_join
from verisect.operators.storage import stored


def snp_join(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Same chromosome, place and ALT base; calls' columns have c_ names."""
    return truth.join(calls, (truth["chr"] == calls["c_chr"]) & (truth["pos"] == calls["c_pos"]) & (truth["alt"] == calls["c_alt"]))


def small_join(truth: DataFrame, calls: DataFrame, ratio: float, ref_len: str | None = None) -> DataFrame:
    """Small variants: same type, place, bases (and reference length), and overlap without wiggle."""
    same = (truth["chr"] == calls["c_chr"]) & (truth["pos"] == calls["c_pos"]) & (truth["overall_type"] == calls["c_overall_type"]) & (truth["alt"] == calls["c_alt"])
    if ref_len:
        same = same & (truth[ref_len] == calls[f"c_{ref_len}"])
    return truth.join(calls, same).filter(C.overlaps(F.col("start"), F.col("end"), F.col("c_start"), F.col("c_end"), ratio, 0))


def candidates(truth: DataFrame, calls: DataFrame, ratio: float, wiggle: int, small: int = C.SV_LENGTH, levels: int | None = None, ignore_insertion_length: bool = False, ref_len: str | None = None) -> DataFrame:
    """Pairs of truth (rec_no, chr, pos, start, end, overall_type, len, alt) and calls (c_ names) that may
    match: SNPs by base, small variants by bases and place, others by overlap within wiggle. Insertions whose
    length is ignored are never small; their start and end should be their place."""
    keep = [*truth.columns, *calls.columns]
    t_small, c_small = C.is_small(F.col("overall_type"), F.col("len"), small, ignore_insertion_length), C.is_small(F.col("c_overall_type"), F.col("c_len"), small, ignore_insertion_length)
    snp = snp_join(truth.filter(F.col("overall_type") == "SNP"), calls.filter(F.col("c_overall_type") == "SNP"))
    exact = small_join(truth.filter(t_small), calls.filter(c_small), ratio, ref_len)
    wide_t, wide_c = truth.filter((F.col("overall_type") != "SNP") & ~t_small), calls.filter((F.col("c_overall_type") != "SNP") & ~c_small)
    wide = interval_join(wide_t, wide_c, wiggle, levels, (("overall_type", "c_overall_type"),), ("chr", "start", "end"), ("c_chr", "c_start", "c_end"))
    wide = wide.filter(C.overlaps(F.col("c_start"), F.col("c_end"), F.col("start"), F.col("end"), ratio, wiggle))
    return snp.select(keep).unionByName(exact.select(keep)).unionByName(wide.select(keep))


#: A call whose earlier rivals are one call that shares so many truths at most is resolved along a chain.
CHAIN_TRUTHS = 4


def _order(truth_order: str = "truth_order", truth: str = "truth") -> Column:
    return F.struct(truth_order, truth)


def _choices(edges: DataFrame, by: tuple[str, ...], pieces: DataFrame | None, genotype: bool) -> DataFrame:
    """What calls take if all their edges are free: (by, piece, truth, matched). by: call, and whatever tells its
    cases apart. pieces: (call, pieces), if a call needs a truth for each piece."""
    hom = F.col("t_hom")
    of = lambda test: F.min(F.when(test, _order()))
    one, two = F.sum(F.when(~hom, F.col("n_p")).otherwise(0)), F.sum(F.when(~hom, F.col("n_m")).otherwise(0))
    each = edges.groupBy(*by, "piece").agg(
        F.any_value("c_hom").alias("c_hom"), of(hom).alias("h"), of(~hom & (F.col("n_p") > 0) & (F.col("n_m") > 0)).alias("both"), of(~hom & (F.col("n_p") > 0)).alias("p"), of(~hom & (F.col("n_m") > 0)).alias("m"), one.alias("k_p"), two.alias("k_m"),
        F.max("len").alias("longest"),
    )
    het = F.coalesce(F.col("both"), F.when(F.col("k_p") > F.col("k_m"), F.col("p")).otherwise(F.col("m")))
    best = F.when(F.col("c_hom"), F.col("h")).otherwise(het) if genotype else F.coalesce(F.col("h"), het)
    taken = each.select(*by, "piece", best["truth"].alias("truth"), F.col("longest").alias("matched")).filter("truth is not null")
    if pieces is None:
        return taken
    full = taken.groupBy(*by).agg(F.count("*").alias("__k")).join(pieces, "call").filter("__k = pieces")
    return taken.join(full.select(*by), list(by), "left_semi")


def _rivals(left: DataFrame) -> DataFrame:
    """left with ``rival`` and ``rival_order``, the earliest call that wants the truth, and ``second``, the order of
    the one after it. Only the earliest two are looked up, so a truth that many calls want lists no pairs."""
    first = left.groupBy("truth").agg(F.min(F.struct("call_order", "call")).alias("__r"))
    held = left.join(first, "truth").select(left.columns + [F.col("__r.call").alias("rival"), F.col("__r.call_order").alias("rival_order")])
    second = held.filter("call_order > rival_order").groupBy("truth").agg(F.min("call_order").alias("second"))
    return held.join(second, "truth", "left")


def _chains(held: DataFrame, ready: DataFrame, took: DataFrame, pieces: DataFrame | None, genotype: bool) -> tuple[DataFrame, DataFrame] | None:
    """(free edges, calls) of calls along chains, as if the calls before them had been decided one by one.

    A member is a call with one earlier rival, which it shares CHAIN_TRUTHS truths with at most. What the rival
    takes of them is a state (a bit for each); what the member takes in each state gives the state of those that
    follow it. Such maps are composed along the chain by doubling, up to the first member's rival. held: all edges
    of the round, from _rivals; ready: calls that the round decides; took: what they take.
    """
    waits = F.col("call_order") > F.col("rival_order")
    third = F.count_if(waits & (F.col("call_order") > F.col("second")))
    one = held.groupBy("call").agg(F.count_if(waits).alias("k"), third.alias("third"), F.min(F.when(waits, F.col("rival"))).alias("parent"), F.max(F.when(waits, F.col("rival"))).alias("other"))
    one = one.filter(f"k between 1 and {CHAIN_TRUTHS} and third = 0 and parent = other").select("call", "parent")
    shared = held.filter(waits).join(one, "call").groupBy("call", "parent").agg(F.array_sort(F.collect_set("truth")).alias("shared"))  # CHAIN_TRUTHS at most
    members = stored(shared)
    if not members.limit(1).count():
        return None
    cases = "shiftleft(1, size(shared))"
    states = members.select("call", F.explode(F.expr(f"sequence(0, {cases} - 1)")).alias("state"))
    bits = members.select("call", "parent", F.posexplode("shared").alias("bit", "truth"))
    gone = F.expr("coalesce(shiftright(state, bit) & 1, 0) = 1")
    columns = [c for c in held.columns if c not in ("rival", "rival_order", "second")]
    own = stored(held.select(columns).join(members.select("call"), "call", "left_semi").join(bits.drop("parent"), ["call", "truth"], "left"))
    takes = _choices(own.join(states, "call").filter(~gone), ("call", "state"), pieces, genotype)
    # the state of each member, by the state of its rival if that is a member too
    met = bits.join(takes.select(F.col("call").alias("parent"), "state", "truth").distinct(), ["parent", "truth"]).groupBy("call", "state").agg(F.sum(F.expr("shiftleft(1, bit)")).cast("int").alias("mine"))
    grid = members.select("call", "parent").join(states.select(F.col("call").alias("parent"), "state"), "parent").join(met, ["call", "state"], "left")
    maps = grid.groupBy("call", "parent").agg(F.array_sort(F.collect_list(F.struct("state", F.coalesce("mine", F.lit(0)).alias("mine")))).alias("m"))
    inner = maps.select("call", F.col("parent").alias("at"), F.transform("m", lambda x: x["mine"]).alias("m"), F.lit(False).alias("top"))
    roots = members.join(members.select(F.col("call").alias("parent")), "parent", "left_anti")
    way = stored(inner.unionByName(roots.select("call", F.col("call").alias("at"), F.expr(f"sequence(0, {cases} - 1)").alias("m"), F.lit(True).alias("top"))))
    while way.filter("not top").limit(1).count():
        on = way.select(F.col("call").alias("at"), F.col("at").alias("next"), F.col("m").alias("n"), F.col("top").alias("ends"))
        through = F.transform("n", lambda x: F.element_at("m", x + 1))
        way = stored(way.join(on, "at").select("call", F.col("next").alias("at"), through.alias("m"), F.col("ends").alias("top")))
    # roots whose rival this round decides are known, and so is all that hangs on them
    sure = roots.select("call").join(bits, "call").join(ready.select(F.col("call").alias("parent")), "parent", "left_semi")
    lost = took.select(F.col("call").alias("parent"), "truth").distinct().withColumn("lost", F.lit(1))
    at_root = sure.join(lost, ["parent", "truth"], "left").groupBy(F.col("call").alias("at")).agg(F.sum(F.expr("shiftleft(coalesce(lost, 0), bit)")).cast("int").alias("s"))
    known = stored(way.join(at_root, "at").select("call", F.element_at("m", F.col("s") + 1).alias("state")))
    return own.join(known, "call").filter(~gone).select(columns), known.select("call")


def ordered_match(edges: DataFrame, pieces: DataFrame | None = None, genotype: bool = False) -> DataFrame:
    """What calls take, one after the other in call_order: (call, call_order, piece, truth, matched).

    Each piece takes the best truth that no earlier call took; pieces of one call don't compete. pieces (call,
    pieces): a call takes truth only if each of its pieces can, else nothing. edges may have c_hom and t_hom
    (whether both haplotypes carry the piece), n_p and n_m (how often the truth's haplotypes match, for those
    that aren't t_hom) and len; the best truth is the first homozygous one, else the first that both haplotypes
    match, else the first of the haplotype with more matches. genotype: homozygous pieces take homozygous truth
    only, and heterozygous pieces heterozygous truth only. matched: the longest truth that was free.

    A round decides every call that no earlier undecided call shares a truth with, then all chains that hang on
    these calls (see _chains); what they took and their edges go. So a chain of any length takes two rounds, and
    the number of rounds is that of calls with several undecided rivals that wait for each other.
    """
    given = {"c_hom": F.lit(True), "t_hom": F.lit(True), "n_p": F.lit(0), "n_m": F.lit(0), "len": F.lit(0)}
    filled = edges.select("call", "call_order", "piece", "truth", "truth_order", *((F.col(c) if c in edges.columns else v).alias(c) for c, v in given.items())).distinct()
    if pieces is not None:
        able = filled.groupBy("call").agg(F.count_distinct("piece").alias("__k")).join(pieces, "call").filter("__k = pieces").select("call")
        filled = filled.join(able, "call", "left_semi")
    left, out = stored(filled), []
    while left.limit(1).count():
        held = stored(_rivals(left))
        waiting = held.filter("call_order > rival_order").select("call").distinct()
        ready = stored(held.join(waiting, "call", "left_anti").select(left.columns))
        took = stored(_choices(ready, ("call", "call_order"), pieces, genotype))
        done, found = ready.select("call"), took
        if out and (chain := _chains(held, ready.select("call").distinct(), took, pieces, genotype)):
            free, known = chain
            found = stored(took.unionByName(_choices(free, ("call", "call_order"), pieces, genotype)))
            done = done.union(known)
        out.append(found)
        left = stored(left.join(done.distinct(), "call", "left_anti").join(found.select("truth").distinct(), "truth", "left_anti").select(left.columns))
    empty = left.select("call", "call_order", "piece", "truth", F.col("len").alias("matched")).limit(0)
    return reduce(DataFrame.unionByName, [o.select("call", "call_order", "piece", "truth", "matched") for o in out], empty)


def greedy_match(edges: DataFrame) -> DataFrame:
    """The edges (call, call_order, piece, truth) that the ordered assignment takes, one per call piece at most."""
    return ordered_match(edges).drop("matched")


def match_whole_calls(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """As greedy_match, but a call takes truth only if all its pieces (call, pieces) can."""
    return ordered_match(edges, pieces).drop("matched")


def validated_lengths(matches: DataFrame, whole: str) -> DataFrame:
    """Per whole variant: the matched length, and the largest distances of the pieces matched; matches:
    (whole, len, d_start, d_end, d_len)."""
    return matches.groupBy(whole).agg(F.sum("len").alias("validated"), *(F.max(F.abs(F.col(d))).alias(d) for d in ("d_start", "d_end", "d_len")))


def truth_outcome(truth: DataFrame, validated: DataFrame, ratio: float, key: str = "rec_no") -> DataFrame:
    """TP if something is validated and at least ratio of the total length is, else FN; ``known`` (a
    boolean column, if there is one) false makes it unknown."""
    joined = truth.join(validated, key, "left").withColumn("validated", F.coalesce("validated", F.lit(0)))
    hit = (F.col("validated") > 0) & (F.col("validated") >= F.col("len") * ratio)
    said = F.when(hit, "TP").otherwise("FN")
    known = F.col("known") if "known" in truth.columns else F.lit(True)
    return joined.withColumn("outcome", F.when(known, said).otherwise(F.when(hit, "unknown_TP").otherwise("unknown_FN")))


def call_outcome(calls: DataFrame, validated: DataFrame, ratio: float, key: str = "rec_no") -> DataFrame:
    """FP if less than ratio of a call's length is validated, else TP; outside regions unknown_FP."""
    joined = calls.join(validated, key, "left").withColumn("validated", F.coalesce("validated", F.lit(0)))
    false = (F.col("validated") == 0) | (F.col("validated") < F.col("len") * ratio)
    known = F.col("known") if "known" in calls.columns else F.lit(True)
    return joined.withColumn("outcome", F.when(~false, "TP").when(known, "FP").otherwise("unknown_FP"))


def split_flag(pieces: DataFrame, whole: str, ratio: float, sv_length: int = C.SV_LENGTH) -> DataFrame:
    """Adds ``split``: a big variant of several pieces with one dominant piece is counted by pieces."""
    w = Window.partitionBy(whole)
    total = F.sum("len").over(w)
    return pieces.withColumn("split", (total >= sv_length) & (F.max("len").over(w) >= total * ratio) & (F.count("*").over(w) > 1))


def disallow_partial_fp(calls: DataFrame, edges: DataFrame, missed: DataFrame, key: str = "rec_no") -> DataFrame:
    """Calls that touch any missed truth become FP; edges (call, truth), missed (truth)."""
    touching = edges.join(missed.select("truth").distinct(), "truth", "left_semi").select(F.col("call").alias(key)).distinct().withColumn("__bad", F.lit(True))
    joined = calls.join(touching, key, "left")
    return joined.withColumn("outcome", F.when(F.coalesce("__bad", F.lit(False)) & ~F.col("outcome").startswith("unknown"), "FP").otherwise(F.col("outcome"))).drop("__bad")
