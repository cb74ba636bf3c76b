"""Near duplicates by whole shingle sets: SimHash and MinHash propose pairs, the Jaccard similarity decides.

Candidates are the links of SimHash fingerprints, and texts that share a band of MinHash values. Two texts
of similarity s share none of ``BANDS`` bands of ``ROWS`` values with a chance of (1 - s ** ROWS) ** BANDS:
3e-4 at 0.8, 8e-6 at 0.85. No pair is linked before its whole sets of shingles were compared.

Hot spots. A group of near copies shares nearly all bands, so its pairs are never listed: first each member
is compared with the smallest of its band, and the links found give groups. In bands whose members are still
in different groups, each is compared with the member that has the fewest shingles of its own, which is the
middle of the band. Then only those members of a band are compared that are still in different groups: of
few members those pairs that can be similar (shingles that no other open text has can't be common to a
pair), and many members in memory, within cells of a bounded size that report no pairs but links.
This finds the components that all pairs of the bands would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.llm import simhash
from verisect.llm.common import hot_keys, if_small, joined, over_texts, salted, stored

BANDS, ROWS, PIECE = 20, 5, 4096
#: Members of a band up to which pairs are listed; what a chunk of more members has at most, about.
FEW, CELL_ROWS, CELL_SHINGLES = 8, 2048, 1 << 21
_RNG = np.random.default_rng(3)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, n: int) -> list[np.ndarray]:
    """The hashes of a text's n-word shingles, in pieces; none for a text without words (or null)."""
    return list(simhash._shingle_hashes((text or "").encode("utf-8").lower(), n))


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The set of hashes, in order."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values."""
    low, least = (found ^ (found >> np.uint64(32))).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), PIECE):
        np.minimum(least, (_TIMES[:, None] * low[s : s + PIECE] + _PLUS[:, None]).min(axis=1), out=least)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = (h ^ least[k::ROWS]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _marked(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, node, fp, bands) of every row; texts without words are one node, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, marks, nodes = [], [], []
            for t, h in zip(b.column(2), b.column(1).to_pylist(), strict=True):
                parts = hashes(t.as_py(), n)
                found = distinct(parts)
                fps.append(simhash.of_hashes(parts))
                marks.append(bands(found) if len(found) else [])
                nodes.append(h if len(found) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "fp", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return over_texts(slim, run, "doc_id long, text_hash long, node long, fp long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, found): the shingle set of every text in nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 100):
                part = b.slice(s, 100)
                found = [distinct(hashes(t.as_py(), n)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("text"))
    # copies are brought together within tasks first; few nodes are looked up before texts move at all
    wanted = if_small(nodes)
    once = texts.dropDuplicates(["node"]).join(nodes, "node", "left_semi") if wanted is nodes else texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return over_texts(once, run, "node long, found array<long>")


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether two texts can be that similar, by their sizes na, nb and shingles of their own ua, ub: what
    they have in common is in neither's own, and is at least s / (1 + s) of both sizes."""
    common = F.least(F.col(f"n{a}") - F.col(f"u{a}"), F.col(f"n{b}") - F.col(f"u{b}"))
    return common >= F.lit(similarity / (1 + similarity)) * (F.col(f"n{a}") + F.col(f"n{b}")) - F.lit(1e-6)


def _named(sizes: DataFrame, end: str) -> DataFrame:
    return sizes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("own").alias(f"u{end}"))


def verified(sets: DataFrame, sizes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets (node, found) have at least that Jaccard similarity; sizes:
    (node, n, own). A pair whose sizes rule it out is not compared; pairs of a text that is in many of them
    are dealt to several tasks. pairs is read more than once."""
    often = hot_keys(pairs.select(F.explode(F.array("u", "v")).alias("node")), "node")

    def with_ends(rows: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
        return salted(salted(rows, u, "u", "v", often), v, "v", "u", often)

    fit = with_ends(pairs, _named(sizes, "u"), _named(sizes, "v")).filter(_may_link("u", "v", similarity)).select("u", "v", "nu", "nv")
    both = with_ends(fit, sets.select(F.col("node").alias("u"), F.col("found").alias("a")), sets.select(F.col("node").alias("v"), F.col("found").alias("b")))
    common = F.size(F.array_intersect("a", "b"))
    return stored(both.filter(common >= F.lit(similarity) * (F.col("nu") + F.col("nv") - common) - F.lit(1e-9)).select("u", "v"))


def _ordered(u: str, v: str):
    return F.least(u, v).alias("u"), F.greatest(u, v).alias("v")


def components(docs: DataFrame, own: DataFrame, n: int, radius: int, similarity: float) -> DataFrame:
    """(fp, label) of the texts that have near duplicates; both are nodes of own."""
    texts = stored(own.filter("node <> 0").groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    first = stored(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("node").alias("n")))
    at = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
    linked = simhash.links(first.select("fp"), radius).join(at("u"), "u").join(at("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    same = joined(texts.select("node", "fp"), first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    shared = texts.select("node", F.explode("bands").alias("band"))
    hubs = stored(shared.groupBy("band").agg(F.min("node").alias("hub"), F.count("node").alias("n")).filter("n > 1"))
    members = stored(joined(shared, hubs, "band"))
    stars = members.select(F.col("node").alias("u"), F.col("hub").alias("v"))
    pairs = stored(stars.union(linked).union(same).filter("u <> v").select(*_ordered("u", "v")).distinct())
    sets = stored(_sets(docs, stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), n))
    sizes = stored(sets.select("node", F.size("found").alias("n"), F.lit(0).alias("own")))
    found = verified(sets, sizes, pairs, similarity)
    labels = simhash.components(found)

    def still_open() -> DataFrame:
        """(band, node, label) of the bands whose members are not all in one group."""
        held = members.join(labels, members.node == labels.fp, "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        held = stored(held)
        apart = stored(held.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("node").alias("n")).filter("a <> b").select("band", "n"))
        return stored(joined(held, apart, "band"))

    # what no other open text has tells how far a text is from the middle of its band
    rest = still_open()
    if not rest.limit(1).count():
        return labels
    inside = rest.select("node").distinct()
    alone = sets.join(inside, "node", "left_semi").select("node", F.explode("found").alias("x")).groupBy("x").agg(F.min("node").alias("node"), F.count("x").alias("times"))
    alone = alone.filter("times = 1").groupBy("node").agg(F.count("node").cast("int").alias("alone"))
    sizes = stored(sizes.drop("own").join(inside, "node").join(alone, "node", "left").select("node", "n", F.coalesce("alone", F.lit(0)).alias("own")))
    share = F.struct(F.col("own") / F.col("n"), "node")
    middle = stored(rest.join(sizes, "node").groupBy("band").agg(F.min_by("node", share).alias("hub"), F.min_by("label", share).alias("of"), F.count("node").alias("n")))
    around = stored(joined(rest, middle, "band").filter("label <> of").select(*_ordered("node", "hub")).distinct().join(pairs, ["u", "v"], "left_anti"))
    found = stored(found.union(verified(sets, sizes, around, similarity)))
    labels = simhash.components(found)
    # now all pairs of members in different groups: few members as pairs, many within cells
    rest = still_open()
    sized = stored(rest.join(sizes, "node"))
    many = stored(sized.groupBy("band").agg(F.count("node").alias("members"), F.sum("n").alias("shingles")))
    found = found.unionByName(_across_few(sized.join(many.filter(F.col("members") <= FEW).select("band"), "band"), sets, sizes, pairs, similarity))
    found = found.unionByName(_across_many(sized.join(many.filter(F.col("members") > FEW), "band"), sets, similarity))
    return simhash.components(found)


def _across_few(members: DataFrame, sets: DataFrame, sizes: DataFrame, done: DataFrame, similarity: float) -> DataFrame:
    """Links between members (band, node, label, n, own) of a band that are in different groups."""
    members = stored(members)
    end = lambda e: members.select("band", F.col("node").alias(e), F.col("label").alias(f"l{e}"), F.col("n").alias(f"n{e}"), F.col("own").alias(f"u{e}"))
    a, b = end("u"), end("v")
    across = a.join(b, (a["band"] == b["band"]) & (F.col("u") < F.col("v")) & (F.col("lu") != F.col("lv")) & _may_link("u", "v", similarity))
    return verified(sets, sizes, stored(across.select("u", "v").distinct().join(done, ["u", "v"], "left_anti")), similarity)


def _across_many(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The same for bands of many members (with members and shingles, the band's sums): no pair is listed.

    A band is dealt to chunks, and a cell compares two chunks (or one with itself) in memory; it reports no
    more links than join its groups.
    """
    pieces = F.greatest(F.ceil(F.col("members") / CELL_ROWS), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    own = members.select("band", "node", "label", pieces.alias("g")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = own.select("band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "label").join(sets, "node")

    def cell(rows: pa.Table) -> pa.Table:
        node, label, chunk = (rows.column(c).to_numpy() for c in ("node", "label", "c"))
        found = rows.column("found").combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        u, v = linked(found.flatten().to_numpy(), np.diff(found.offsets.to_numpy()), label, chunk, similarity)
        return pa.table({"u": np.minimum(node[u], node[v]), "v": np.maximum(node[u], node[v])})

    return stored(dealt.select("band", "i", "j", "c", "node", "label", "found").groupBy("band", "i", "j").applyInArrow(cell, "u long, v long"))


def linked(shingles: np.ndarray, sizes: np.ndarray, label: np.ndarray, chunk: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines that join all groups that similar lines link; lines of one chunk meet only if there is
    one chunk. shingles: the lines' sets, one after the other."""
    m = len(sizes)
    _, token, times = np.unique(shingles, return_inverse=True, return_counts=True)
    line = np.repeat(np.arange(m), sizes)
    common = times[token] > 1  # the others are in no two lines
    token, line = np.unique(token[common], return_inverse=True)[1], line[common]
    order = np.argsort(token, kind="stable")
    by_token, starts = line[order], np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    lengths = np.diff(starts)
    dense = m * m * len(lengths) / 50 < float((lengths.astype(float) ** 2).sum())
    groups = simhash._Forest(m)
    for one in np.unique(label):
        if len(same := np.flatnonzero(label == one)) > 1:
            groups.join(same)
    both = len(np.unique(chunk)) > 1
    u, v = [], []
    step = max(1, (1 << 22) // max(1, m))
    line_starts = np.searchsorted(line, np.arange(m + 1))
    for s in range(0, m, step):
        e = min(m, s + step)
        shared = np.zeros((e - s, m), np.float32)
        if dense:
            for t in range(0, len(lengths), 2048):
                has = np.zeros((m, min(2048, len(lengths) - t)), np.float32)
                part = (token >= t) & (token < t + 2048)
                has[line[part], token[part] - t] = 1
                shared += has[s:e] @ has.T
        else:
            for x in range(s, e):
                mine = token[line_starts[x] : line_starts[x + 1]]
                size = lengths[mine]
                at = np.repeat(starts[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                shared[x - s] = np.bincount(by_token[at], minlength=m)
        near = shared >= similarity * (sizes[s:e, None] + sizes[None, :] - shared) - 1e-6
        near &= label[s:e, None] != label[None, :]
        if both:
            near &= chunk[s:e, None] != chunk[None, :]
        for a, b in zip(*np.nonzero(near), strict=True):
            pair = np.array([a + s, b])
            if len(np.unique(groups.roots(pair))) > 1:
                groups.join(pair)
                u.append(a + s)
                v.append(b)
    return np.array(u, np.int64), np.array(v, np.int64)


def keep_one(docs: DataFrame, shingle_words: int, radius: int, similarity: float) -> DataFrame:
    """The rows of docs without near duplicates: of each component of texts linked at that similarity, the
    row of the smallest (doc_id, text_hash), nulls last; of exact repeats of that row, one. Texts without
    words (or null) are duplicates of each other; very long texts are taken whole. Columns of docs with any
    name stay; an empty table gives an empty result."""
    own = stored(_marked(docs, shingle_words))
    labels = components(docs, own, shingle_words, radius, similarity)
    rows = own.select("doc_id", "text_hash", "node")
    sizes = rows.groupBy("node").agg(F.count("node").alias("n"))
    found = stored(sizes.join(labels, sizes.node == labels.fp, "left").select("node", "n", F.coalesce("label", "node").alias("component_fp")))
    return simhash.keep_first(docs, stored(joined(rows, found, "node").select("doc_id", "text_hash", "component_fp")))
