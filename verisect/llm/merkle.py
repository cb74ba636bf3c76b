"""A Merkle manifest of a dataset: one tree a source, one tree over the sources.

Slot pivot: nodes are numbered from 0 within their tree, and node i is child ``i % fanout`` of node
``i div fanout`` of the level above. A conditional aggregate a slot spreads the children of a parent into
columns; the parent's digest is the hash of the columns side by side, and a child's siblings are the same
columns without its own. Levels are built from the leaves up, each a third of the one below, and proofs are
handed down by joins of a level with the one above, so both ways handle about half as many rows as there are
leaves, and no task holds a tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import if_small, stored, table

FANOUT = 3
#: The columns that a leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:``, and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*(framed(v) for v in values))


def ordered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, a row's place in its tree (from 0), and ``n``, the rows of the tree; nulls come first.

    Rows are sorted over all trees and written once with their places; a tree's share of a partition starts
    where the partitions before it end. A window sees one row for each tree and partition, never rows.
    """
    sorted_ = rows.orderBy(tree, *(F.col(c).asc_nulls_first() for c in order))
    laid = stored(sorted_.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    shares = laid.groupBy(tree, "__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__k"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__k").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = stored(shares.select(tree, "__p", (before - F.col("__first")).alias("__shift"), F.sum("__k").over(w).alias("n")))
    return laid.join(if_small(shares), [tree, "__p"]).withColumn("idx", F.col("__i") + F.col("__shift")).drop("__p", "__i", "__shift")


def _slots(value: Column, fanout: int, name: str) -> list[Column]:
    """The slot pivot: one column for each child of a parent."""
    return [F.max(F.when(F.col("idx") % fanout == s, value)).alias(f"{name}{s}") for s in range(fanout)]


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels and tops of trees; nodes: (tree, idx, n, digest, and ``own``, what a leaf keeps).

    A level has a row for each parent: tree, idx, n (children in the tree), their digests in c0, c1, ... and
    for the lowest one what they own in o0, o1, ... A tree is left out from the level at which it has one node
    on. tops: (tree, height, digest, own), where own is null unless the tree is a lone leaf. The number of
    levels is the logarithm of the largest tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops = [nodes.filter("n = 1").select("tree", F.lit(0).alias("height"), "digest", "own")]
    levels, below, own = [], nodes, nodes.schema["own"].dataType
    while most > 1:
        more = _slots(F.col("own"), fanout, "o") if not levels else []
        level = below.filter("n > 1").groupBy("tree", "n", F.floor(F.col("idx") / fanout).alias("parent")).agg(*_slots(F.col("digest"), fanout, "c"), *more)
        levels.append(stored(level.withColumnRenamed("parent", "idx")))
        most = -(-most // fanout)
        joined = digest(*(F.coalesce(f"c{s}", F.lit("")) for s in range(fanout)))
        below = levels[-1].select("tree", "idx", F.ceil(F.col("n") / fanout).alias("n"), joined.alias("digest"), F.lit(None).cast(own).alias("own"))
        tops.append(below.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest", "own"))
    return levels, reduce(DataFrame.unionByName, tops)


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with their proofs: (tree, digest, own, path, and further columns of tops, which tops hand down).

    path: for each level from the leaf's run up, the digests of its siblings before and after it, one string
    each; it goes on with the path of the tree's top.
    """
    kept = [c for c in tops.columns if c not in ("tree", "height", "digest", "own", "path")]
    lone = tops.filter("height = 0").select("tree", "digest", "own", "path", *kept)
    paths = None
    for k in range(len(levels), 0, -1):
        at = tops.filter(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("idx"), "path", *kept)
        paths = at if paths is None else paths.unionByName(at)
        col = lambda s: F.coalesce(f"c{s}", F.lit(""))
        beside = lambda slots: F.concat(F.lit(""), *(col(s) for s in slots))
        step = lambda s: F.struct(beside(range(s)).alias("before"), beside(range(s + 1, fanout)).alias("after"))
        owns = lambda s: [F.col(f"o{s}").alias("own")] if k == 1 else []
        child = [F.when(F.col(f"c{s}").isNotNull(), F.struct((F.col("idx") * fanout + s).alias("idx"), F.col(f"c{s}").alias("digest"), F.concat(F.array(step(s)), F.col("path")).alias("path"), *owns(s))) for s in range(fanout)]
        below = levels[k - 1].join(paths, ["tree", "idx"]).select("tree", F.explode(F.array_compact(F.array(*child))).alias("x"), *kept)
        paths = below.select("tree", "x.idx", "x.path", *kept, *([] if k > 1 else ["x.digest", "x.own"]))
    return lone if paths is None else lone.unionByName(paths.drop("idx"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda d, s: digest(s["before"], d, s["after"]))


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs (the columns of FIELDS): doc_id, leaf, subroot, root, proof (the siblings from
    leaf to root, one string), folded_root (of ``changed``, the leaf as it may have become, or of the leaf
    itself) and verified.

    Null ids come first in their source, repeated ids stand in the order of their leaves; a null source is a
    source of its own and the first one; a source of one row has its leaf as subroot; an empty table gives an
    empty result. Further columns of docs don't count.
    """
    own = leaf(*(F.col(c) for c in FIELDS))
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source")))  # keeps the order
    hashed = docs.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), (own if changed is None else changed).alias("changed"))
    hashed = stored(hashed)
    leaves = ordered(hashed, "tree", ["doc_id", "digest"]).withColumn("own", F.struct("doc_id", "changed"))
    levels, tops = climb(leaves, fanout)
    tops = stored(tops)
    roots = ordered(tops.select(F.lit("").alias("forest"), "tree", F.col("digest").alias("subroot")), "forest", ["tree"])
    upper, root = climb(roots.select(F.col("forest").alias("tree"), "idx", "n", F.col("subroot").alias("digest"), F.struct("tree").alias("own")), fanout)
    top = root.withColumns({"path": F.array().cast(_PATH), "root": F.col("digest")})
    subtrees = stored(descend(upper, top, fanout).select(F.col("own.tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    found = descend(levels, tops.join(subtrees, "tree"), fanout)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = found.select("own.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"), fold(F.col("own.changed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Query: the manifest of all documents, where texts of every other id (by CRC) lose their line ends."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, leaf(*(F.col(c) for c in FIELDS[:-1]), text))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(d, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_FRAMED = ", ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in FIELDS[:-1])

OP12_SQL = f"""
with recursive rows_ as (
  select doc_id, source, text, doc_id::varchar as d, concat({_FRAMED}) as head from documents
), hashed as (
  select doc_id, source, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
    case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as after, head
  from rows_
), leaves as (
  select *, sha256(head || coalesce(strlen(after)::varchar || ':' || after, '-')) as changed, coalesce('+' || source, '') as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n
  from hashed
), up as (
  select tree, 0 as lvl, idx, n, leaf as digest from leaves
  union all
  select tree, lvl + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(digest, '' order by idx)) from up where n > 1 group by tree, lvl, idx // 3
), subroots as (
  select tree, digest as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from up where n = 1
), top as (
  select 0 as lvl, idx, n, subroot as digest from subroots
  union all
  select lvl + 1, idx // 3, max((n + 2) // 3), sha256(string_agg(digest, '' order by idx)) from top where n > 1 group by lvl, idx // 3
), beside as (
  select a.tree, a.lvl, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as before,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as after
  from up a join up b on a.tree = b.tree and a.lvl = b.lvl and a.idx // 3 = b.idx // 3 where a.n > 1 group by a.tree, a.lvl, a.idx
), beside_top as (
  select a.lvl, a.idx, coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as before,
    coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as after
  from top a join top b on a.lvl = b.lvl and a.idx // 3 = b.idx // 3 where a.n > 1 group by a.lvl, a.idx
), inside as (
  select tree, idx as place, 0 as lvl, idx as at, changed as digest, '' as proof, doc_id, leaf, n from leaves
  union all
  select i.tree, i.place, i.lvl + 1, i.at // 3, sha256(s.before || i.digest || s.after), i.proof || s.before || s.after, i.doc_id, i.leaf, (i.n + 2) // 3
  from inside i join beside s on i.tree = s.tree and i.lvl = s.lvl and i.at = s.idx where i.n > 1
), above as (
  select i.doc_id, i.leaf, s.subroot, 0 as lvl, s.idx as at, i.digest, i.proof, s.n from inside i join subroots s on i.tree = s.tree where i.n = 1
  union all
  select a.doc_id, a.leaf, a.subroot, a.lvl + 1, a.at // 3, sha256(s.before || a.digest || s.after), a.proof || s.before || s.after, (a.n + 2) // 3
  from above a join beside_top s on a.lvl = s.lvl and a.at = s.idx where a.n > 1
)
select doc_id, leaf, subroot, (select digest from top where n = 1) as root, sha256(proof) as proof_sha256, digest as folded_root,
  digest = (select digest from top where n = 1) as verified
from above where n = 1
"""
