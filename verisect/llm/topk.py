"""Exact top-k inner products by pivot-table elimination.

Vectors are turned into integers floor(1024 * x). Every vector has a row of the pivot table, computed once:
its Euclidean distances to many pivots. By the triangle inequality the largest difference between a query's
and a candidate's rows is a lower bound of their distance d, and q.x = (|q|^2 + |x|^2 - d^2) / 2 turns it
into an upper bound of the score. A query takes its candidates in the order of that bound, and stops once
the next bound is below its k-th best score: what is left can't get in.

The same bound holds for whole cells. A cell has at most about ``row_block`` vectors that are nearest to the
same pivot, and knows the smallest and largest distance of its members to each pivot, and their largest
length. First each query is answered in the cell of the highest bound alone; its k-th best score there is
its threshold. Then it goes to those other cells whose bound reaches the threshold. A cell's vectors are sent
once for every ``query_block`` queries that come, and not at all if none does. Each visit returns at most k
rows, and a last grouping by query keeps the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisect.llm.common import stored, table

SCALE, TOP, QUERY_EVERY = 1024, 10, 100
PIVOTS, SAMPLE = 32, 2000
QUERY_BLOCK, ROW_BLOCK = 512, 16_384


def usable(vector: Column) -> Column:
    """Not null, and no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; what is beyond a long ends at its limits."""
    limit = float(1 << 63)
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))), F.lit(-(1 << 62))), F.lit(1 << 62)).cast("long"))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Far-apart vectors of a sample: each next one has the largest distance to those before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample * sample).sum(axis=1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to dim."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, int)] = flat
    return out


def column(rows: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    chunks = rows.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], rows.schema.field(name).type)


def spread(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A number below parts for each id, by a hash; 0 where parts is 0."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)


def _exact(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products; floats hold them exactly if small, else Python's integers do."""
    if small:
        return (rows.astype(np.float64, copy=False) @ query.astype(np.float64)).astype(np.int64)
    big = rows.astype(object) @ query.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in big], np.int64)


def upper_bounds(q2: float, norms: np.ndarray, below: np.ndarray, reach: float) -> np.ndarray:
    """What a score is at most: q2 and norms are squared lengths, below bounds distances from below, reach
    is the largest distance in use. A little is added for rounding."""
    below = np.maximum(below - 1e-9 * (reach + 1.0), 0.0)
    return (q2 + norms - below * below) / 2 + 1e-9 * (q2 + norms) + 1e-6


def best_of(query: np.ndarray, query_row: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, norms: np.ndarray, k: int, small: bool, threshold: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one query in a cell, ties to smaller ids, and how many were evaluated.

    pivots: one line for each pivot, with the distance of each row. Rows that can't reach the threshold are
    left out.
    """
    q2 = float(query.astype(np.float64) @ query.astype(np.float64))
    below = np.zeros(len(rows))
    for line, d in zip(pivots, query_row, strict=True):
        np.maximum(below, np.abs(line - d), out=below)
    bound = upper_bounds(q2, norms, below, float(max(pivots.max(initial=0.0), query_row.max(initial=0.0))))
    left = np.flatnonzero(bound >= threshold)
    order = left[np.argsort(-bound[left], kind="stable")]
    found: list[tuple[int, int]] = []
    at, step = 0, 256
    while at < len(order):
        if len(found) == k and bound[order[at]] < -found[-1][0]:
            break
        part = order[at : at + step]
        part = part[ids[part] != own]
        scores = _exact(rows[part], query, small)
        # only scores that can still get in are merged; ties stay, as a smaller id wins
        hope = scores >= -found[-1][0] if len(found) == k else np.ones(len(part), bool)
        found = sorted([*found, *((-int(s), int(i)) for s, i in zip(scores[hope], ids[part][hope], strict=True))])[:k]
        at += step
        step = min(2 * step, 4096)
    return [(-s, i) for s, i in found], min(at, len(order))


_FOUND = "query_id long, vec_id long, score long, evaluated long"


class Table:
    """The pivot table: rows (vec_id, v, home, p, norm), and what each cell knows of its members."""

    def __init__(self, vectors: DataFrame, pivots: int, sample: int, row_block: int):
        slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).filter(F.col("vec_id").isNotNull() & usable(F.col("e")))
        rows = stored(slim.select("vec_id", integers(F.col("e")).alias("v")))
        n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        self.dim = dim = max(1, dim)
        drawn = rows.filter(F.pmod(F.xxhash64(F.lit("pivots"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))).select("vec_id", "v").collect()
        points = _matrix(pa.array([r.v for r in sorted(drawn)[: 2 * sample]], pa.list_(pa.int64())), dim).astype(np.float64)
        self.chosen = chosen = choose_pivots(points, pivots) if len(points) else np.zeros((1, dim))

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = _matrix(b.column(1), dim).astype(np.float64)
                p = np.stack([np.sqrt(((y - c) ** 2).sum(axis=1)) for c in chosen], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.argmin(axis=1), pa.int32()), lists, pa.array((y * y).sum(axis=1))], ["vec_id", "v", "home", "p", "norm"])

        schema = "vec_id long, v array<long>, home int, p array<double>, norm double"
        placed = stored(rows.mapInArrow(distances, schema))
        # one row for each pivot; a home of many rows is several cells
        sizes = {r.home: r["count"] for r in placed.groupBy("home").count().collect()}
        parts = np.array([max(1, math.ceil(sizes.get(h, 0) / row_block)) for h in range(len(chosen))])
        first = np.cumsum(parts) - parts
        self.cells = int(parts.sum())

        def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                home = b.column(2).to_numpy()
                # repeats of a row are spread as well
                cell = first[home] + spread(b.column(0).to_numpy() + np.arange(len(home)), parts[home])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), *b.columns[3:]], ["vec_id", "v", "cell", "p", "norm"])

        # where no home is cut, homes are the cells, and no row is written again
        self.rows = stored(placed.mapInArrow(to_cell, schema.replace("home", "cell"))) if (parts > 1).any() else placed.withColumnRenamed("home", "cell")
        width = len(chosen)

        def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, most = np.full((self_cells, width), np.inf), np.full((self_cells, width), -np.inf), np.full(self_cells, -1.0)
            for b in batches:
                cell, p = b.column(0).to_numpy(), _matrix(b.column(1), width)
                np.minimum.at(low, cell, p)
                np.maximum.at(high, cell, p)
                np.maximum.at(most, cell, b.column(2).to_numpy())
            there = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(list(low[there]), pa.list_(pa.float64())), pa.array(list(high[there]), pa.list_(pa.float64())), pa.array(most[there])], ["cell", "low", "high", "most"])

        self_cells = self.cells
        self.low, self.high, self.most = np.full((self.cells, width), np.inf), np.full((self.cells, width), -np.inf), np.full(self.cells, -1.0)

        def widest(got: pa.Table) -> pa.Table:
            """What the tasks found of a cell, as one row."""
            low, high = (_matrix(column(got, name), width) for name in ("low", "high"))
            line = lambda x: pa.array([x], pa.list_(pa.float64()))
            return pa.table({"cell": got.column("cell").slice(0, 1), "low": line(low.min(axis=0)), "high": line(high.max(axis=0)), "most": pa.array([got.column("most").to_numpy().max()])})

        extents = "cell int, low array<double>, high array<double>, most double"
        # one row for each cell and task meets, and one for each cell is known to the driver
        for r in self.rows.select("cell", "p", "norm").mapInArrow(extent, extents).groupBy("cell").applyInArrow(widest, extents).collect():
            self.low[r.cell], self.high[r.cell], self.most[r.cell] = r.low, r.high, r.most

    def cell_bounds(self, p: np.ndarray, q2: float) -> np.ndarray:
        """What a query's score is at most in each cell; -inf in an empty one."""
        there = self.most >= 0
        below = np.maximum(np.maximum(self.low - p, p - self.high).max(axis=1), 0.0)
        reach = float(max(p.max(), self.high[there].max(initial=0.0)))
        with np.errstate(invalid="ignore"):
            return np.where(there, upper_bounds(q2, np.maximum(self.most, 0.0), np.where(there, below, 0.0), reach), -np.inf)


def visits(table_: Table, asked: DataFrame, k: int, query_block: int) -> DataFrame:
    """Answers of asked (vec_id, v, p, norm, cells, threshold) in their cells."""
    dim, width, cells = table_.dim, len(table_.chosen), table_.cells
    # one row for each cell
    copies = np.zeros(cells, np.int64)
    for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        copies[r.cell] = -(-r["count"] // query_block)
    names = ["cell", "part", "asks", "vec_id", "v", "p", "norm", "threshold"]
    schema = "cell int, part int, asks boolean, vec_id long, v array<long>, p array<double>, norm double, threshold double"

    def dealt(b: pa.RecordBatch, line: np.ndarray, cell: np.ndarray, part: np.ndarray, asks: bool, threshold: pa.Array) -> pa.RecordBatch:
        at = pa.array(line)
        own = [b.column(b.schema.get_field_index(c)).take(at) for c in ("vec_id", "v", "p", "norm")]
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(line), asks)), *own, threshold], names)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                lists = b.column(b.schema.get_field_index("cells"))
                line, cell = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)
                part = spread(b.column(b.schema.get_field_index("vec_id")).to_numpy()[line], copies[cell])
                yield dealt(b, line, cell, part, True, b.column(b.schema.get_field_index("threshold")).take(pa.array(line)))

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                cell = b.column(b.schema.get_field_index("cell")).to_numpy()
                times = copies[cell]
                line = np.repeat(np.arange(len(b)), times)
                part = np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
                yield dealt(b, line, cell[line], part, False, pa.array(np.full(len(line), -np.inf)))

    def answer(got: pa.Table) -> pa.Table:
        asks, ids = got.column("asks").to_numpy(zero_copy_only=False), got.column("vec_id").to_numpy()
        x, p, norm, threshold = _matrix(column(got, "v"), dim), _matrix(column(got, "p"), width), got.column("norm").to_numpy(), got.column("threshold").to_numpy()
        small = bool(len(x) == 0 or float(np.abs(x.astype(np.float64)).max()) ** 2 * dim < 2.0**52)
        rows, own, norms, table_rows = x[~asks].astype(np.float64) if small else x[~asks], ids[~asks], norm[~asks], np.ascontiguousarray(p[~asks].T)
        out: list[tuple[int, int, int, int]] = []
        for n in np.flatnonzero(asks):
            found, evaluated = best_of(x[n], p[n], int(ids[n]), rows, own, table_rows, norms, k, small, threshold[n])
            # the number goes with one row of the visit, even if nothing was found
            out += [(int(ids[n]), vec, score, 0) for score, vec in found] + [(int(ids[n]), None, None, evaluated)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score", "evaluated"), zip(*out, strict=True) if out else [[]] * 4, strict=True)})

    both = asked.mapInArrow(deal_queries, schema).unionByName(table_.rows.mapInArrow(deal_rows, schema))
    # cells take time, not room: Spark must not put them together because they are small
    tasks = max(1, min(int(copies.sum()), 8 * asked.sparkSession.sparkContext.defaultParallelism, 100_000))
    return both.repartition(tasks, "cell", "part").groupBy("cell", "part").applyInArrow(answer, _FOUND)


def search(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, **options) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to smaller ids.

    vectors: (vec_id, embedding). Queries are the rows whose vec_id is divisible by every, candidates all
    rows with another vec_id. Vectors that are null or hold null, NaN or infinite components take no part,
    nor do rows without a vec_id. Shorter vectors count as padded with zeros. Repeated rows are each a
    candidate; a repeated query is asked once. Scores beyond a long end at its limits. Other columns are not
    looked at. An empty table gives an empty result. sample bounds the vectors from which the driver takes
    pivots.
    """
    return ranked(answers(vectors, k, every, **options), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.filter("vec_id is not null").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answers(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, evaluated): the rows that visits returned; and for each visit one row
    without vec_id that says how many candidates it evaluated."""
    known = Table(vectors, pivots, sample, row_block)
    width, schema = len(known.chosen), "vec_id long, v array<long>, p array<double>, norm double, cells array<int>, threshold double"
    queries = known.rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "v", "p", "norm")

    def choose(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """The cell of the highest bound; or the others whose bound reaches the threshold."""
        for b in batches:
            p, norm = _matrix(b.column(2), width), b.column(3).to_numpy()
            threshold = np.full(len(b), -np.inf) if first else b.column(4).to_numpy(zero_copy_only=False)
            cells = []
            for row, q2, least in zip(p, norm, threshold, strict=True):
                bounds = known_bounds(row, float(q2))
                at = int(bounds.argmax())
                cells.append([at] if first else [int(c) for c in np.flatnonzero((bounds >= least) & (bounds > -np.inf)) if c != at])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cells, pa.list_(pa.int32())), pa.array(threshold)], ["vec_id", "v", "p", "norm", "cells", "threshold"])

    slim = Table.__new__(Table)  # what tasks need, without the frames
    slim.low, slim.high, slim.most = known.low, known.high, known.most
    known_bounds = slim.cell_bounds
    near = stored(queries.mapInArrow(lambda batches: choose(batches, True), schema))
    begun = stored(visits(known, near, k, query_block))
    kth = F.when(F.count("score") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf")))
    least = begun.groupBy("query_id").agg(kth.alias("threshold"))
    told = near.drop("cells", "threshold").join(least, near.vec_id == least.query_id).select("vec_id", "v", "p", "norm", "threshold")
    rest = stored(told.mapInArrow(lambda batches: choose(batches, False), schema))
    return begun.unionByName(visits(known, rest, k, query_block))


def evaluated_share(vectors: DataFrame, every: int = QUERY_EVERY, **options) -> float:
    """The share of all (query, candidate) pairs that a search evaluates: what elimination leaves."""
    found = answers(vectors, every=every, **options)
    done = found.agg(F.sum("evaluated")).first()[0] or 0
    ids = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id")
    return done / max(1, ids.count() * ids.filter(F.col("vec_id") % every == 0).distinct().count())


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """Query: the 10 best of every hundredth vector against all."""
    return search(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with parts as (
  select vec_id, embedding, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where vec_id is not null and embedding is not null
), usable as (
  select vec_id, v from parts where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select * from usable where vec_id % 100 = 0) q join usable c on q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
