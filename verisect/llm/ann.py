"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample of at most about ``max(sample, sample_per_leaf * leaves)`` rows and has about
sqrt(n) leaves; every row is then sent down it and belongs to the leaf it reaches. A query walks the tree
with a priority queue: the node whose centre is nearest is opened next, and leaves come out in the order in
which they are reached. How many leaves a query visits is calibrated: for a bounded set of calibration
queries the true neighbours among all rows are computed, and the number is raised until their mean recall
reaches ``recall``.

For the largest inner product, vectors get one more component that makes all lengths equal (0 for a
query), so that the nearest centre by Euclidean distance is meant; scores use the original vectors.

Leaves are searched in cells: about ``block_rows`` rows of consecutive leaves (a larger leaf is several
blocks) against at most about ``query_block`` of the queries that visit any of these leaves. Rows of a block
that many queries visit are copied to as many cells as that takes, and rows that none visits to no cell. In
a cell a query is compared with the rows of its own leaves only, and takes at most k rows from it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import stored, table
from verisect.llm.topk import _matrix, column, spread, usable

NEAREST, QUERY_EVERY = 20, 20
RECALL, CALIBRATION_QUERIES, SAMPLE, SAMPLE_PER_LEAF = 0.94, 400, 20_000, 16
BRANCHES, BLOCK_ROWS, QUERY_BLOCK = 8, 4096, 2048
#: Scores that a cell holds at once.
HELD = 1 << 21


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        centres = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
    return centres


def build(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 3) -> list[tuple]:
    """The tree as nodes (centres, children); a leaf is (leaf number,). At most about ``leaves`` leaves."""
    rng, nodes, made = np.random.default_rng(seed), [], 0

    def grow(x: np.ndarray, share: float) -> int:
        nonlocal made
        at = len(nodes)
        nodes.append(())
        k = min(branches, max(1, round(share)))
        centres = np.unique(_kmeans(x, k, rng), axis=0) if k > 1 and len(x) >= 2 * k else x[:0]
        near = _nearest(x, centres) if len(centres) > 1 else np.zeros(len(x), int)
        if not np.ptp(near) if len(near) else True:  # nothing to tell rows apart
            nodes[at] = (made,)
            made += 1
            return at
        nodes[at] = (centres, [grow(x[near == i], share * (near == i).mean()) for i in range(len(centres))])
        return at

    grow(sample, leaves)
    return nodes


def leaf_count(nodes: list[tuple]) -> int:
    return sum(len(node) == 1 for node in nodes)


def home(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The leaf of each row: always to the nearest centre."""
    out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if len(nodes[at]) == 1:
            out[rows] = nodes[at][0]
        elif len(rows):
            near = _nearest(x[rows], nodes[at][0])
            todo += [(c, rows[near == i]) for i, c in enumerate(nodes[at][1])]
    return out


def best_bins(query: np.ndarray, nodes: list[tuple], visits: int) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first walk."""
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, at = heapq.heappop(queue)
        if len(nodes[at]) == 1:
            out.append(nodes[at][0])
            continue
        centres, children = nodes[at]
        for d, child in zip(((centres * centres).sum(axis=1) - 2 * (centres @ query)).tolist(), children, strict=True):
            heapq.heappush(queue, (d, child))
    return out


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired lines in double precision, summed in the same order everywhere."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        out += queries[:, j] * rows[:, j]
    return out


def best(rough: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query line, row line, score) of the k best of each query, ties to smaller ids.

    rough: scores up to rounding, -inf where a row is no candidate. What may be among the k best by rough
    scores is scored exactly.
    """
    n = rough.shape[1]
    least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
    with np.errstate(over="ignore"):
        slack = 1e-13 * max(1, rows.shape[1]) * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1).max(initial=0.0))
    sure = np.isfinite(least) & np.isfinite(slack)
    keep = rough >= np.where(sure, least - np.where(sure, slack, 0.0), -np.inf)[:, None]
    keep &= rough != -np.inf
    q, r = np.nonzero(keep)
    score = np.concatenate([_exact(queries[q[s : s + 65_536]], rows[r[s : s + 65_536]]) for s in range(0, len(q), 65_536)] or [np.zeros(0)])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, np.arange(len(rough)))
    top = np.arange(len(q)) - first[q] < k
    return q[top], r[top], score[top]


def _found(query_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, **more: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64()), **{name: pa.array(x) for name, x in more.items()}})


def search(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, recall: float = RECALL, sample: int = SAMPLE, sample_per_leaf: int = SAMPLE_PER_LEAF, calibration_queries: int = CALIBRATION_QUERIES, branches: int = BRANCHES, leaves: int | None = None, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by inner product.

    vectors: (vec_id, embedding). Queries are the rows whose vec_id is divisible by every, candidates all
    rows with another vec_id; ties go to the smaller vec_id. Vectors that are null, zero (or empty) or hold
    null, NaN or infinite components take no part, nor do rows without a vec_id. Shorter vectors count as
    padded with zeros. Repeated rows are each a candidate; a repeated query is asked once. Other columns are
    not looked at. An empty table gives an empty result. leaves: about sqrt(n) if None. sample and
    sample_per_leaf bound the rows on which the tree is fitted, calibration_queries (with all rows as
    candidates) those that set the number of visits.
    """
    index = Index(vectors, every, recall, k, sample, sample_per_leaf, calibration_queries, branches, leaves)
    found = index.cells(block_rows, query_block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Index:
    """The tree, every row's leaf, and the number of leaves that a query visits."""

    def __init__(self, vectors: DataFrame, every: int, recall: float, k: int, sample: int, sample_per_leaf: int, calibration_queries: int, branches: int, leaves: int | None):
        self.k = k
        doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
        doubles = doubles.filter(F.col("vec_id").isNotNull() & usable(F.col("e")) & F.exists("e", lambda x: x != 0))
        self.rows = rows = stored(doubles.select("vec_id", F.col("e").cast("array<double>").alias("v")))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        n, self.dim, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
        dim = self.dim
        draw = lambda what: F.pmod(F.xxhash64(F.lit(what), "vec_id"), F.lit(1 << 30)) / float(1 << 30)

        def lifted(x: np.ndarray) -> np.ndarray:
            rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
            return np.concatenate([x, np.where(rest > 1e-6 * math.sqrt(longest), rest, 0.0)[:, None]], axis=1)

        def taken(df: DataFrame, what: str, bound: int, among: int) -> tuple[np.ndarray, np.ndarray]:
            """A hashed sample of about bound rows as (ids, vectors), in order of the ids."""
            got = df.filter(draw(what) < min(1.0, bound / max(1, among))).select("vec_id", "v").toArrow().combine_chunks()
            ids, x = got.column("vec_id").to_numpy(), _matrix(column(got, "v"), dim)
            order = np.lexsort((*x.T[::-1], ids))[: 2 * bound]
            return ids[order], x[order]

        aim = leaves or max(1, math.isqrt(n))
        bound = max(sample, sample_per_leaf * aim)
        self.nodes = nodes = build(lifted(taken(rows, "tree", bound, n)[1]), aim, branches)
        self.leaves = leaf_count(nodes)

        def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home(lifted(_matrix(b.column(1), dim)), nodes))], ["vec_id", "v", "leaf"])

        self.indexed = stored(rows.mapInArrow(to_leaf, "vec_id long, v array<double>, leaf int"))
        asking = rows.filter(F.col("vec_id") % every == 0)
        among = asking.count()
        # a walk takes time, not room: Spark must not put the few rows together
        self.queries = asking.repartition(max(1, -(-among // 256)), "vec_id").dropDuplicates(["vec_id"])
        self.visits = self._calibrated(*taken(self.queries, "calibrate", calibration_queries, among), recall)

    def _calibrated(self, asked: np.ndarray, x: np.ndarray, recall: float) -> int:
        """The fewest visits at which the trial queries' mean recall reaches ``recall``."""
        if not len(asked) or self.leaves == 1:
            return self.leaves
        k, dim = self.k, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, ids, leaf = _matrix(b.column(1), dim), b.column(0).to_numpy(), b.column(2).to_numpy()
                rough = x @ rows.T
                rough[asked[:, None] == ids[None, :]] = -np.inf
                q, r, score = best(rough, x, rows, ids, k)
                yield from _found(asked[q], ids[r], score, leaf=leaf[r]).to_batches()

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        # k rows for each trial query
        true = self.indexed.mapInArrow(run, "query_id long, vec_id long, score double, leaf int").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "leaf").collect()
        place = {int(i): {leaf: p for p, leaf in enumerate(best_bins(np.append(q, 0.0), self.nodes, self.leaves))} for i, q in zip(asked, x, strict=True)}
        need = sorted(place[r.query_id][r.leaf] + 1 for r in true)
        return need[min(len(need), math.ceil(recall * len(need))) - 1] if need else self.leaves

    def cells(self, block_rows: int, query_block: int) -> DataFrame:
        """(query_id, vec_id, score): at most k rows of each cell for each of its queries."""
        dim, k, nodes, visits, every_leaf = self.dim, self.k, self.nodes, self.visits, self.leaves
        # one row per leaf, about sqrt(n)
        sizes = np.zeros(every_leaf, np.int64)
        for r in self.indexed.groupBy("leaf").count().collect():
            sizes[r.leaf] = r["count"]
        parts = np.maximum(1, -(-sizes // block_rows))
        first, at, filled = np.zeros(every_leaf, np.int64), 0, 0
        for leaf in range(every_leaf):
            if filled and (parts[leaf] > 1 or filled + sizes[leaf] > block_rows):
                at, filled = at + 1, 0
            first[leaf] = at
            filled += sizes[leaf]
            if parts[leaf] > 1:
                at, filled = at + int(parts[leaf]), 0
        blocks = int((first + parts).max())

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.pad(_matrix(b.column(1), dim), ((0, 0), (0, 1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([best_bins(q, nodes, visits) for q in x], pa.list_(pa.int32()))], ["vec_id", "v", "leaves"])

        walked = stored(self.queries.mapInArrow(walk, "vec_id long, v array<double>, leaves array<int>"))

        def visited(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(line, block, leaf) of every visit, in order; a leaf of several parts is visited in each."""
            leaf = lists.flatten().to_numpy(zero_copy_only=False)
            line = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            times = parts[leaf]
            start = np.repeat(np.cumsum(times) - times, times)
            line, leaf, block = np.repeat(line, times), np.repeat(leaf, times), np.repeat(first[leaf], times) + np.arange(times.sum()) - start
            order = np.lexsort((leaf, block, line))
            return line[order], block[order], leaf[order]

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(blocks, np.int64)
            for b in batches:
                line, block, _ = visited(b.column(0))
                total += np.bincount(np.unique(line * blocks + block) % blocks, minlength=blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], ["block", "n"])

        copies = np.zeros(blocks, np.int64)
        for r in walked.select("leaves").mapInArrow(asked, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
            copies[r.block] = -(-r.n // query_block)

        names = ["block", "part", "asks", "vec_id", "v", "leaves"]
        schema = "block int, part int, asks boolean, vec_id long, v array<double>, leaves array<int>"

        def dealt(block: np.ndarray, part: np.ndarray, asks: bool, b: pa.RecordBatch, line: np.ndarray, leaves: pa.Array) -> pa.RecordBatch:
            at = pa.array(line)
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(line), asks)), b.column(0).take(at), b.column(1).take(at), leaves], names)

        def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 256):
                    b = whole.slice(s, 256)
                    line, block, leaf = visited(b.column(2))
                    new = np.flatnonzero(np.diff(line * blocks + block, prepend=-1))
                    own, where = line[new], block[new]
                    part = spread(b.column(0).to_numpy()[own], copies[where])
                    yield dealt(where, part, True, b, own, pa.ListArray.from_arrays(pa.array(np.append(new, len(line)), pa.int32()), pa.array(leaf, pa.int32())))

        def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 1024):
                    b = whole.slice(s, 1024)
                    leaf = b.column(2).to_numpy()
                    # repeats of a row are spread as well
                    where = first[leaf] + spread(b.column(0).to_numpy() + np.arange(len(leaf)), parts[leaf])
                    times = copies[where]
                    line = np.repeat(np.arange(len(leaf)), times)
                    part = np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
                    yield dealt(where[line], part, False, b, line, pa.ListArray.from_arrays(pa.array(np.arange(len(line) + 1), pa.int32()), pa.array(leaf[line], pa.int32())))

        def cell(got: pa.Table) -> pa.Table:
            got = got.combine_chunks()
            asks, ids, x, lists = got.column("asks").to_numpy(zero_copy_only=False), got.column("vec_id").to_numpy(), _matrix(column(got, "v"), dim), column(got, "leaves")
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            leaf = flat[starts[:-1][~asks]]
            order = np.lexsort((ids[~asks], leaf))
            leaf, rows, row_ids = leaf[order], x[~asks][order], ids[~asks][order]
            there, begins = np.unique(leaf, return_index=True)
            ends = np.append(begins[1:], len(leaf))
            asking = np.flatnonzero(asks)
            sees = np.zeros((len(asking), every_leaf), bool)
            sees[np.repeat(np.arange(len(asking)), (starts[1:] - starts[:-1])[asking]), flat[np.repeat(asks, np.diff(starts))]] = True
            queries, query_ids, out = x[asks], ids[asks], []
            step = max(1, HELD // max(1, len(rows)))
            for s in range(0, len(queries), step):
                part = queries[s : s + step]
                rough = np.full((len(part), len(rows)), -np.inf)
                for n, (a, z) in zip(there, zip(begins, ends, strict=True), strict=True):
                    if len(mine := np.flatnonzero(sees[s : s + step, n])):
                        rough[mine, a:z] = part[mine] @ rows[a:z].T
                rough[query_ids[s : s + step, None] == row_ids[None, :]] = -np.inf
                q, r, score = best(rough, part, rows, row_ids, k)
                out.append(_found(query_ids[s : s + step][q], row_ids[r], score))
            return pa.concat_tables(out) if out else _found(*np.zeros((3, 0)))

        both = walked.mapInArrow(deal_queries, schema).unionByName(self.indexed.mapInArrow(deal_rows, schema))
        # cells take time, not room: Spark must not put them together because they are small
        tasks = max(1, min(int(copies.sum()), 8 * self.rows.sparkSession.sparkContext.defaultParallelism, 100_000))
        return both.repartition(tasks, "block", "part").groupBy("block", "part").applyInArrow(cell, "query_id long, vec_id long, score double")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    """Query: the 20 nearest found of every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"))
