"""Conflict filter and block map of ordered variants on one haplotype.

Variants: rec_no, chr, pos, ref_len (0 for an insertion), ins_len (bases that they add), overall_type, cn, and
if known ref_deleted (the padding base before pos, or empty). Their order is by the place of the padding base if
there is one, else of pos, and then by record number; the first one in order is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.operators import setops
from verisect.operators.intervals import interval_join
from verisect.operators.scan import in_order, scanned
from verisect.operators.storage import stored


def _accepted_changes(changes: DataFrame) -> DataFrame:
    """Those of variants with reference bases (rec_no, chr, key, start, end) that are accepted: (rec_no).

    Variants of one key (place of the padding base) start at the key or one base after it, and all earlier ones
    start at the key at most. So all that matters of those accepted before is where their bases end: before the
    key (then up to two of the key's variants are accepted), at the key (then the first that starts after it can
    be), or beyond (none can). A key and the first two cases are nodes, and what a node accepts says where its
    bases end, and so which node comes next. The nodes on the way from the first key of an island (variants whose
    spans meet, one after the other) are found by doubling.
    """
    rows = scanned(in_order(changes, ["chr", "key", "rec_no"]), ("chr",), maxes={"reach": F.col("end")})
    head = F.col("reach").isNull() | (F.col("key") > F.col("reach"))
    # later variants of an island's first key do not begin an island; they have the same key
    heads = rows.groupBy("chr", "key").agg(F.bool_or(head).alias("head"), F.max("end").alias("most"), F.count("*").alias("n"))
    at = lambda one: F.min(F.when(F.col("start") == F.col("key") + (0 if one else 1), F.struct("rec_no", "end")))
    groups = rows.groupBy("chr", "key").agg(at(True).alias("here"), at(False).alias("next"))
    groups = groups.join(heads, ["chr", "key"])
    # the first in order, and after it the first of the other kind that it leaves room for
    room_next = F.when(F.col("here.end") == F.col("key"), F.col("next.rec_no"))
    short = rows.filter((F.col("start") == F.col("key")) & (F.col("end") == F.col("key"))).groupBy("chr", "key").agg(F.min("rec_no").alias("short"))
    groups = groups.join(short, ["chr", "key"], "left")
    here_first = F.col("next").isNull() | F.coalesce(F.col("here.rec_no") < F.col("next.rec_no"), F.lit(False))
    free = F.when(here_first, F.array_compact(F.array(F.col("here.rec_no"), room_next))).otherwise(F.array_compact(F.array(F.col("next.rec_no"), F.when(F.col("short") > F.col("next.rec_no"), F.col("short")))))
    ends = F.when(here_first, F.greatest(F.col("here.end"), F.when(F.col("here.end") == F.col("key"), F.col("next.end")))).otherwise(F.col("next.end"))
    laid = in_order(groups.select("chr", "key", "head", "most", "n", F.col("next").isNotNull().alias("half"), F.col("next.rec_no").alias("half_takes"), F.col("next.end").alias("half_end"), free.alias("takes"), ends.alias("end")), ["chr", "key"])
    keys = scanned(laid, sums={"no": F.lit(1), "island": F.col("head").cast("int")}, following={"next_head": F.col("head")})
    keys = stored(keys.withColumn("island", F.col("island") + F.col("head").cast("int")))
    alone = keys.filter("head and coalesce(next_head, true)").select(F.explode("takes").alias("rec_no"))
    keys = keys.filter("not (head and coalesce(next_head, true))")
    nodes = keys.select("chr", "no", "island", "head", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("mode"), "takes", "end"), F.when(F.col("half"), F.struct(F.lit(1).alias("mode"), F.array("half_takes").alias("takes"), F.col("half_end").alias("end")))))).alias("x")).select("chr", "no", "island", "head", "x.*")
    # how many keys lie before a node's end: keys and ends in one order, counted along
    marks = keys.select("chr", F.col("key").alias("at"), F.lit(1).alias("is_key"), F.lit(None).cast("long").alias("node")).unionByName(nodes.select("chr", F.col("end").alias("at"), F.lit(0).alias("is_key"), (2 * F.col("no") + F.col("mode")).alias("node")))
    ranked = keys.select("no", "chr", "key", "island", "half")
    order = scanned(in_order(ranked, ["no"]), sums={"rank": F.lit(1)})
    placed = scanned(in_order(marks, ["chr", "at", "is_key"]), sums={"rank": F.col("is_key")}).filter("node is not null").select("node", "rank")
    target = order.select("rank", F.col("no").alias("t_no"), F.col("key").alias("t_key"), F.col("island").alias("t_island"), "half")
    follow = scanned(in_order(order.select("rank", "no", "island"), ["rank"]), following={"after": F.struct("no", "island")}).select(F.col("rank"), "after")
    target = target.join(follow, "rank")
    steps = nodes.select((2 * F.col("no") + F.col("mode")).alias("node"), "island", "end", "head", "mode", "takes").join(placed, "node").join(target, "rank", "left")
    same, after = F.col("t_island") == F.col("island"), F.col("after.island") == F.col("island")
    onward = F.when(same & (F.col("t_key") > F.col("end")), 2 * F.col("t_no")).when(same & F.col("half"), 2 * F.col("t_no") + 1).when(same & after, 2 * F.col("after.no"))
    steps = stored(steps.select("node", "takes", (F.col("head") & (F.col("mode") == 0)).alias("first"), onward.alias("to")))
    reached, jump = stored(steps.filter("first").select("node")), steps.filter("to is not null").select("node", "to")
    while jump.limit(1).count():
        reached = stored(reached.union(jump.join(reached, "node").select("to")).distinct())
        jump = stored(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
    return alone.unionByName(steps.join(reached, "node").select(F.explode("takes").alias("rec_no")))


def drop_conflicts(variants: DataFrame, contig_lengths: DataFrame | None = None) -> DataFrame:
    """Variants (unique by rec_no) that the first accepted ones leave room for: one that touches a base already
    changed is dropped, so is a second insertion at one place, an insertion whose neighbours are both deleted by
    then, and one out of bounds."""
    rows = variants
    if contig_lengths is not None:
        ends = F.broadcast(contig_lengths.select(F.col("contig").alias("chr"), F.col("length").alias("__len")))  # one row per contig
        rows = rows.join(ends, "chr").filter((F.col("pos") >= 1) & (F.col("pos") + F.col("ref_len") - 1 <= F.col("__len"))).drop("__len")
    pad = F.least(F.length(F.coalesce("ref_deleted", F.lit(""))), F.lit(1)) if "ref_deleted" in variants.columns else F.lit(0)
    placed = stored(rows.select("rec_no", "chr", F.col("pos").cast("long").alias("start"), (F.col("pos") - pad).cast("long").alias("key"), (F.col("pos") + F.col("ref_len") - 1).cast("long").alias("end"), "overall_type", (F.col("ref_len") == 0).alias("inserts")))
    changes = placed.filter("not inserts")
    kept = stored(_accepted_changes(changes.select("rec_no", "chr", "key", "start", "end")))
    deleted = changes.filter("overall_type = 'Deletion'").join(kept, "rec_no", "left_semi").select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("key").alias("r_key"), F.col("rec_no").alias("r_rec"))
    inserts = placed.filter("inserts").select("rec_no", "chr", "key", (F.col("start") - 1).alias("start"), F.col("start").alias("end"))
    earlier = F.struct(F.col("r_key"), F.col("r_rec")) < F.struct(F.col("key"), F.col("rec_no"))
    near = interval_join(inserts, deleted).filter(earlier)
    lost = near.groupBy("rec_no").agg(F.bool_or(F.col("r_start") <= F.col("start")).alias("left"), F.bool_or(F.col("r_end") >= F.col("end")).alias("right")).filter("left and right")
    open_ = inserts.join(lost.select("rec_no"), "rec_no", "left_anti").groupBy("chr", "end").agg(F.min_by("rec_no", F.struct("key", "rec_no")).alias("rec_no"))
    return rows.join(kept.unionByName(open_.select("rec_no")), "rec_no", "left_semi")


def priority_union(*frames: DataFrame, contig_lengths: DataFrame | None = None) -> DataFrame:
    """All frames' variants without conflicts; at one place the earlier frame is accepted first."""
    return drop_conflicts(setops.concat_files(*frames), contig_lengths)


def build_block_map(variants: DataFrame, contig_lengths: DataFrame, suffix: str = "_paternal") -> DataFrame:
    """Block map (block_no, size, src_chr, src_loc, dst_chr, dst_loc, direction, feature, variant_id) from
    accepted variants: SEQ blocks in between, and for each variant its own blocks.

    The source is the changed genome, the destination the reference. DEL takes no source; INS, INV and
    tandem copies take no destination, and point to the base before (INV backwards); SNPs stay within SEQ.
    """
    big = variants.filter(~F.col("overall_type").isin("SNP", "MNP"))
    kind: Column = F.col("overall_type")
    size = F.when(kind == "Insertion", F.col("ins_len")).otherwise(F.col("ref_len"))
    feature = F.when(kind == "Insertion", "INS").when(kind == "Deletion", "DEL").when(kind == "Inversion", "INV").otherwise("DUP_TANDEM")
    # a variant's reference bases: what a deletion or inversion takes out; copies stand before the original
    takes = F.when(kind.isin("Deletion", "Inversion"), F.col("ref_len")).otherwise(0)
    marked = big.withColumns({"__f": feature, "__size": size.cast("long"), "__end": (F.col("pos") + takes).cast("long")})
    marked = stored(scanned(in_order(marked, ["chr", "pos", "rec_no"]), ("chr",), previous={"__after": F.col("__end")}))
    none = F.lit(None).cast("long")
    after = F.coalesce("__after", F.lit(1))
    gaps = marked.select("chr", after.alias("ref_at"), F.lit(0).alias("sub"), (F.col("pos") - after).alias("size"), F.lit("SEQ").alias("feature"), none.alias("rec_no"))
    copies = F.when(F.col("__f") == "DUP_TANDEM", F.greatest(F.coalesce("cn", F.lit(2)) - 1, F.lit(1))).otherwise(1)
    own = marked.withColumn("sub", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("chr", F.col("pos").alias("ref_at"), "sub", F.col("__size").alias("size"), F.col("__f").alias("feature"), "rec_no")
    last = marked.groupBy("chr").agg(F.max("__end").alias("__last"))
    rest = F.coalesce("__last", F.lit(1))
    tails = contig_lengths.select(F.col("contig").alias("chr"), "length").join(last, "chr", "left").select("chr", rest.alias("ref_at"), F.lit(0).alias("sub"), (F.col("length") + 1 - rest).alias("size"), F.lit("SEQ").alias("feature"), none.alias("rec_no"))
    blocks = gaps.unionByName(own).unionByName(tails).filter("size > 0").withColumn("is_seq", (F.col("feature") == "SEQ").cast("int"))
    takes_src = F.when(F.col("feature") == "DEL", 0).otherwise(F.col("size"))
    placed = scanned(in_order(blocks, ["chr", "ref_at", "is_seq", "rec_no", "sub"]), ("chr",), sums={"__src": takes_src, "__no": F.lit(1)})
    src = F.col("__src") + 1
    dst = F.when(F.col("feature").isin("SEQ", "DEL"), F.col("ref_at")).otherwise(F.col("ref_at") - 1)
    return placed.select(
        (F.col("__no") + 1).cast("int").alias("block_no"), "size", F.concat("chr", F.lit(suffix)).alias("src_chr"), F.when(F.col("feature") == "DEL", src - 1).otherwise(src).alias("src_loc"),
        F.col("chr").alias("dst_chr"), dst.alias("dst_loc"), F.when(F.col("feature") == "INV", "-").otherwise("+").alias("direction"), "feature", F.col("rec_no").cast("string").alias("variant_id"),
    )
