"""SimHash near-duplicate components through vantage-point trees.

A fingerprint is a 64-bit SimHash of a document's word shingles. Two fingerprints link if they differ
in at most ``radius`` bits; the operator returns the connected component of every document.

Search. The 64 bits are cut into ``m = radius // 2 + 1`` blocks. If two fingerprints differ in at most
``radius`` bits, at least one block differs in at most ``radius // m`` (0 or 1) bits. Hamming distance
within a block is a pseudo-metric, so each block gets a vantage-point tree of its own, whose triangle
bounds use that small block radius: a branch is pruned unless ``|d(x, vantage) - mu| <= radius // m``.
The upper levels of a tree deal the distinct fingerprints to shards: each is at home in one leaf and
visits those later leaves whose boundary lies within the block radius. Inside a shard the same
splitting goes on in memory, and the surviving pairs are compared on all 64 bits. This finds every pair.

Hot spots. Only distinct fingerprints are dealt, so exact copies cost nothing. A shard with more rows
than ``cell_rows`` is split into a grid of cells, each of which compares two chunks of the shard. A
shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisect.llm.common import hot_keys, if_small, joined, over_texts, salted, stored, table

SEED = 42
CHUNK_BYTES = 1 << 20
SAMPLE_PER_LEAF = 8
#: Fingerprints that a task deals to shards, about; and where a shard's number holds its tree's.
DEAL_ROWS, SHARD_BITS = 20_000, 40
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(data: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of each n-word shingle, a bounded piece of the text at a time."""
    digest, carry, start, any_yet = xxhash.xxh64_intdigest, [], 0, False
    while start < len(data):
        end = start + CHUNK_BYTES
        if end < len(data):
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        words = carry + data[start:end].split()
        if len(words) >= n:
            any_yet = True
            grams = zip(*(words[k:] for k in range(n)), strict=False)
            yield np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - n + 1)
            carry = words[len(words) - n + 1 :]
        else:
            carry = words
        start = end
    if carry and not any_yet:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: str | None, n: int) -> int:
    """The SimHash as a signed 64-bit integer; 0 for a text without words (or null)."""
    return of_hashes(_shingle_hashes((text or "").encode("utf-8").lower(), n))  # bytes.lower touches A-Z only


def of_hashes(pieces: Iterable[np.ndarray]) -> int:
    """The SimHash of shingle hashes, a piece at a time."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in pieces:
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; text_hash (xxhash64, null for null) tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle_words) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return over_texts(slim, run, "doc_id long, text_hash long, fp long")


def _masks(radius: int) -> tuple[list[np.uint64], int]:
    m = min(64, radius // 2 + 1)
    edges = [64 * k // m for k in range(m + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)], radius // m


def _distance(x: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ vantage) & mask).astype(np.int16)


def _split(sample: np.ndarray, mask: np.uint64, reach: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and median radius that leave the fewest points near the boundary."""
    best = None
    for vantage in rng.choice(sample, min(8, len(sample)), replace=False):
        d = _distance(sample, vantage, mask)
        for mu in {int(np.median(d)), int(np.median(d)) - 1}:
            inside = int((d <= mu).sum())
            if 0 < inside < len(d):
                cost = max(inside, len(d) - inside) + int((np.abs(d - mu) <= reach).sum()) / 2
                if best is None or cost < best[0]:
                    best = (cost, vantage, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, mask: np.uint64, reach: int, depth: int, seed: int = 1) -> list[tuple]:
    """A vantage-point tree as a list of nodes: (vantage, mu, left, right), or (leaf number,)."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(part: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        split = _split(part, mask, reach, rng) if left and len(part) >= 8 else None
        if split is None:
            nodes[at] = (leaves,)
            leaves += 1
        else:
            d = _distance(part, split[0], mask)
            nodes[at] = (*split, grow(part[d <= split[1]], left - 1), grow(part[d > split[1]], left - 1))
        return at

    grow(sample, depth)
    return nodes


def route(x: np.ndarray, nodes: list[tuple], mask: np.uint64, reach: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf, at home, fingerprints). A row visits, besides its home, the later leaves within reach."""
    todo = [(0, True, x)]
    while todo:
        at, home, part = todo.pop()
        if not len(part):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], home, part
            continue
        vantage, mu, left, right = nodes[at]
        d = _distance(part, vantage, mask)
        if home:
            todo += [(left, True, part[d <= mu]), (right, True, part[d > mu]), (right, False, part[(d <= mu) & (d + reach > mu)])]
        else:
            todo += [(left, False, part[d - reach <= mu]), (right, False, part[d + reach > mu])]


class _Forest:
    """Union of row numbers, kept as labels that point at smaller rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.parent[rows]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def join(self, rows: np.ndarray) -> None:
        r = self.roots(rows)
        low = r.min()
        self.parent[r] = low
        self.parent[rows] = low


def _link(x: np.ndarray, own: np.ndarray, other: np.ndarray, mask: np.uint64, reach: int, radius: int, forest: _Forest) -> None:
    """Join all rows of own with the rows of other within radius; x: fingerprints, own and other: rows."""
    todo = [(own, other)]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) > 64:
            vantage = x[a[len(a) // 2]]
            da = _distance(x[a], vantage, mask)
            mu = int(np.median(da))
            mu -= int((da <= mu).all())
            if (da <= mu).any():
                db = _distance(x[b], vantage, mask)
                todo += [(a[da <= mu], b[db - reach <= mu]), (a[da > mu], b[db + reach > mu])]
                continue
        step = max(1, (1 << 21) // len(b))
        for s in range(0, len(a), step):
            near = np.bitwise_count(x[a[s : s + step], None] ^ x[b][None, :]) <= radius
            for k in np.flatnonzero(near.sum(axis=1) > 0):
                rows = b[near[k]]
                if len(rows) > 1 or rows[0] != a[s + k]:
                    forest.join(np.append(rows, a[s + k]))


def links(fps: DataFrame, radius: int = 4, leaf_rows: int = 4096, sample_rows: int = 8192, cell_rows: int = 60_000) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp`` that differ in at most radius bits.

    leaf_rows is the aim for a shard, cell_rows the most that one task compares. The driver places vantage
    points by a sample of about sample_rows fingerprints, or SAMPLE_PER_LEAF for each shard if that is more
    (8 bytes for 512 fingerprints at the default), and never more than a quarter of all.
    """
    n = fps.count()
    masks, reach = _masks(radius)
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    sample = np.zeros(0, np.uint64)
    if depth:
        part = min(0.25, max(sample_rows, SAMPLE_PER_LEAF << depth) / n)
        got = fps.select("fp").filter(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30)) < int(part * (1 << 30))).toArrow()
        sample = np.sort(got.column("fp").to_numpy()).view(np.uint64)
    trees = [build_tree(sample, mask, reach, depth) for mask in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (mask, nodes) in enumerate(zip(masks, trees, strict=True)):
                if visits := list(route(x, nodes, mask, reach)):
                    sizes = [len(part) for _, _, part in visits]
                    shard = np.repeat([k << SHARD_BITS | leaf for leaf, _, _ in visits], sizes)
                    home = np.repeat([home for _, home, _ in visits], sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(home), pa.array(np.concatenate([part for _, _, part in visits]).view(np.int64))], ["shard", "home", "fp"])

    dealt = stored(fps.select("fp").repartition(max(1, math.ceil(n / DEAL_ROWS))).mapInArrow(deal, "shard long, home boolean, fp long"))
    # one row for each shard that is too full
    grid = stored(dealt.groupBy("shard").count().filter(F.col("count") > cell_rows).select("shard", F.ceil(F.col("count") / cell_rows).cast("int").alias("g")))
    dealt = dealt.withColumn("cell", F.lit(0)).withColumn("side", F.lit(0))
    if grid.limit(1).count():
        # row chunk c of g meets every chunk: cell (min, max), in which the rows of chunk min are side 0
        own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        hot = dealt.select("shard", "home", "fp").join(F.broadcast(grid), "shard").withColumn("c", own)
        hot = hot.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        hot = hot.select("shard", "home", "fp", (F.least("c", "o") * F.col("g") + F.greatest("c", "o")).alias("cell"), F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"))
        dealt = dealt.join(F.broadcast(grid.select("shard")), "shard", "left_anti").unionByName(hot)

    def compare(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        rows = rows.sort_by("fp")  # so that the root of a group is its smallest member
        x = rows.column("fp").to_numpy().view(np.uint64)
        home, side = rows.column("home").to_numpy(zero_copy_only=False), rows.column("side").to_numpy()
        forest, every = _Forest(len(x)), np.arange(len(x))
        for a, b in ((0, 0),) if not side.any() else ((1, 2), (2, 1)):  # homes against all
            _link(x, every[home & (side == a)], every[side == b], masks[shard >> SHARD_BITS], reach, radius, forest)
        root = forest.roots(every)
        at = np.flatnonzero(root != every)
        return pa.table({"u": x[at].view(np.int64), "v": x[root[at]].view(np.int64)})

    return dealt.groupBy("shard", "cell").applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) of every end of edges (u, v): the smallest end that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label, and writes the
    labels to the shared folder; rounds end when no label changes. Nodes of many edges and labels of many
    nodes are dealt to several tasks.
    """
    once = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    # what lies below a node is linked to the lowest there: the same groups with about an edge for each node
    lowest = once.groupBy("u").agg(F.min("v").alias("low"))
    slim = lowest.select("u", F.col("low").alias("v")).union(once.join(lowest, "u").filter("v <> low").select("v", "low"))
    both = stored(slim.union(slim.select("v", "u")).distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("fp"), F.least("u", "v").alias("label")))
    often = hot_keys(both, "v")
    while True:
        seen = salted(both, labels.withColumnRenamed("fp", "v"), "v", "u", often).groupBy("u").agg(F.min("label").alias("near"))
        hooked = stored(labels.join(seen, labels.fp == seen.u).select("fp", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = hooked.select(F.col("fp").alias("label"), F.col("label").alias("top"))
        new = stored(salted(hooked, up, "label", "fp", hot_keys(hooked, "label")).select("fp", F.col("top").alias("label"), (F.col("top") != F.col("was")).alias("moved")))
        labels = new.select("fp", "label")
        if not new.filter("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, **search) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp, component_id, component_fp.

    component_fp is the smallest fingerprint (as a signed long) of the component, never null. component_id is the smallest non-null doc_id that can be reached over links. Null and wordless texts
    have fingerprint 0 and link like any other; a null doc_id keeps its row and is in its component, but
    names none (component_id is null only if all its members' ids are). Repeated rows stay repeated.
    An empty table gives an empty result; other columns of docs are not looked at.
    """
    own = stored(fingerprints(docs, shingle_words))
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("fp").alias("n")))
    labels = components(links(distinct.select("fp"), radius, **search))
    inside = distinct.join(labels, "fp")
    least = inside.groupBy("label").agg(F.min("least").alias("component_id"))
    far = labels.join(least, "label").select("fp", "label", "component_id")
    found = stored(distinct.join(far, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("label", "fp").alias("component_fp")))
    return joined(own, found, "fp").select("doc_id", "text_hash", "fp", "component_id", "component_fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component, the row of the smallest
    (doc_id, text_hash), nulls last; of exact repeats of that row, one."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one, given the component_fp of every row (doc_id, text_hash) of docs."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash").isNull().alias("no_text"), F.col("text_hash"))
    least = stored(found.groupBy("component_fp").agg(F.min(key).alias("k"), F.count("*").alias("n")))
    kept = least.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    # fewer rows go than stay; they are looked up, and if they are few no text is moved
    gone = if_small(stored(joined(found, least, "component_fp").filter(~key.eqNullSafe(F.col("k"))).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()))
    doc_id, text_hash = docs["doc_id"].cast("long"), F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"]))
    left = docs.join(gone, doc_id.eqNullSafe(gone["gone_id"]) & text_hash.eqNullSafe(gone["gone_hash"]), "left_anti")
    sizes = found.groupBy("doc_id", "text_hash").count().filter("count > 1")
    twice = stored(sizes.join(kept, sizes["doc_id"].eqNullSafe(kept["kept_id"]) & sizes["text_hash"].eqNullSafe(kept["kept_hash"]), "left_semi").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")))
    if not twice.limit(1).count():
        return left
    again = doc_id.eqNullSafe(twice["again_id"]) & text_hash.eqNullSafe(twice["again_hash"])
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: every document's fingerprint and component, at the contract's 4 words and 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
