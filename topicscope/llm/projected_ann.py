"""Approximate nearest neighbours: stable projections, kd-tree, chi-square stopping.

Largest inner product becomes smallest Euclidean distance by one added
coordinate sqrt(M^2 - |x|^2) (M the largest norm; 0 for queries), and 2-stable
(Gaussian) projections take that space to ``dims`` dimensions, where the
squared projected distance of a pair over its squared true distance is
chi-square with ``dims`` degrees of freedom.

* Index: the distinct vectors are dealt into cells by the top of a kd-tree over
  the projections; its splits are fitted on a bounded sample (``sample_rows``),
  every row is indexed.  Each cell is a kd-tree of its own leaves in its task.
* Search: a query's leaves are visited by projected distance (incremental
  neighbours) and their vectors are verified with the exact inner product; it
  stops when the next leaf is so far that a vector still better than the k-th
  found would be seen there with probability below ``miss``: the
  chi-square test Psi(next^2 / d_k^2) >= 1 - miss.
* First in the query's own cell, which bounds d_k; then in those other cells
  whose box passes the same test.

Equal vectors are one point with its k + 1 smallest ids: a later copy cannot
be among the k nearest of any query, so nothing is lost.  A cell over
``cell_max`` points is dealt into parts by a hash; queries stream past a
cell's points, so memory is bounded by a part.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part; null ids neither; beyond the end of the shorter of two
vectors components count as 0.  Rows that repeat an id with equal vectors count
once; an id at several vectors is a row, and a query, for each of them, and any
row but the query's own is a candidate, also one of the same id.  No candidates
give no rows for that query, an empty table none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Queries that a cell part answers together; bounds the score block to BLOCK x step x leaf size.
BLOCK = 256


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom (closed-form tail, bisection)."""
    def tail(x: float) -> float:
        term = total = 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return float(np.exp(-x / 2)) * total
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
    return (low + high) / 2


@dataclass
class Space:
    """Projection and the top of the kd-tree (heap order; a cell is a leaf number)."""
    matrix: np.ndarray       # (vector length + 1) x dims
    norm2: float             # largest squared norm
    axis: np.ndarray
    at: np.ndarray
    lows: np.ndarray         # boxes of the cells
    highs: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1) @ self.matrix

    def project_queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), "i8")
        inner = len(self.axis)
        while inner and node[0] < inner:   # a complete tree: all reach the leaves together
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - inner

    def box_gap2(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from each query to each cell's box."""
        gap = np.maximum(np.maximum(self.lows[None] - q[:, None], q[:, None] - self.highs[None]), 0)
        return (gap * gap).sum(axis=2)


def fit_space(sample: np.ndarray, norm2: float, dims: int, depth: int, seed: int = 5) -> Space:
    """Split the sample's projections at medians, widest axis first."""
    rng = np.random.default_rng(seed)
    space = Space(rng.standard_normal((sample.shape[1] + 1, dims)), norm2, np.zeros(0, "i8"), np.zeros(0), np.zeros((1, dims)), np.zeros((1, dims)))
    p = space.lift(sample)
    axis, at = np.zeros((1 << depth) - 1, "i8"), np.zeros((1 << depth) - 1)
    lows, highs = np.full((1 << (depth + 1)) * dims, -np.inf).reshape(-1, dims), np.full((1 << (depth + 1)) * dims, np.inf).reshape(-1, dims)
    groups = {0: np.arange(len(p))}
    for node in range(len(axis)):
        ids = groups.pop(node)
        rows = p[ids]
        if len(rows):
            axis[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            at[node] = float(np.median(rows[:, axis[node]]))
        left, right = 2 * node + 1, 2 * node + 2
        for child in (left, right):
            lows[child], highs[child] = lows[node], highs[node]
        highs[left, axis[node]] = lows[right, axis[node]] = at[node]
        side = rows[:, axis[node]] > at[node]
        groups[left], groups[right] = ids[~side], ids[side]
    n = len(axis)
    space.axis, space.at, space.lows, space.highs = axis, at, lows[n:2 * n + 1], highs[n:2 * n + 1]
    return space


class Leaves:
    """kd-tree of one cell part: points in leaves of at most ``size``, with their boxes."""

    def __init__(self, p: np.ndarray, size: int = 64):
        parts, todo = [], [np.arange(len(p))]
        while todo:
            rows = todo.pop()
            if len(rows) <= size:
                parts.append(rows)
                continue
            x = p[rows]
            k = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            order = np.argpartition(x[:, k], len(rows) // 2)
            todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.rows = np.concatenate(parts)
        self.ends = np.cumsum([len(r) for r in parts])
        self.starts = self.ends - [len(r) for r in parts]
        self.lows = np.stack([p[r].min(axis=0) for r in parts])
        self.highs = np.stack([p[r].max(axis=0) for r in parts])


def search(leaves: Leaves, x: np.ndarray, q: np.ndarray, pq: np.ndarray, k: int, chi2: float, top2: np.ndarray, floor: np.ndarray, step: int = 8):
    """(query row, row of x in leaf order, score) of the best ``k`` of each query of a block, scores above ``floor`` first.

    ``x`` is in leaf order; ``top2`` is M^2 + |q|^2, so a score s is at squared
    distance top2 - 2 s.  Every query takes its own leaves in order of
    projected distance, in groups of ``step``, and leaves the block when its
    test holds; a leaf's vectors are verified for all queries that ask it in
    that turn.  Scores are evaluated again pair by pair, so they do not depend
    on the block; ``slack`` keeps ties within rounding.
    """
    gap = np.maximum(np.maximum(leaves.lows[None] - pq[:, None], pq[:, None] - leaves.highs[None]), 0)
    gap = np.einsum("ijk,ijk->ij", gap, gap)
    order = np.argsort(gap, axis=1, kind="stable")
    width = int((leaves.ends - leaves.starts).max())
    slack, kth, best = 1e-12 * top2, floor.astype("f8"), np.full((len(q), k), -np.inf)
    found_q, found_i, found_s = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]
    todo = np.arange(len(q))
    for turn in range(0, order.shape[1], step):
        # those whose chi-square test holds are done
        todo = todo[gap[todo, order[todo, turn]] <= chi2 * np.maximum(top2[todo] - 2 * kth[todo], 0)]
        if not len(todo):
            break
        ask = order[todo, turn:turn + step]
        s = np.full((*ask.shape, width), -np.inf)
        for j in np.unique(ask):
            who, slot = np.nonzero(ask == j)
            s[who, slot, :leaves.ends[j] - leaves.starts[j]] = q[todo[who]] @ x[leaves.starts[j]:leaves.ends[j]].T
        seen = np.concatenate([best[todo], s.reshape(len(todo), -1)], axis=1)
        best[todo] = -np.partition(-seen, k - 1, axis=1)[:, :k]
        kth[todo] = np.maximum(kth[todo], best[todo].min(axis=1))
        who, slot, at = np.nonzero((s > -np.inf) & (s >= (kth - slack)[todo][:, None, None]))
        found_q.append(todo[who])
        found_i.append(leaves.starts[ask[who, slot]] + at)
        found_s.append(s[who, slot, at])
    who, at, s = np.concatenate(found_q), np.concatenate(found_i), np.concatenate(found_s)
    keep = s >= (kth - slack)[who]
    who, at = who[keep], at[keep]
    return who, at, np.einsum("ij,ij->i", q[who], x[at])


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda c: c != 0))
    longest = v.agg(F.max(F.size("v"))).first()[0] or 0
    return v.withColumn("v", F.when(F.size("v") < longest, F.concat("v", F.array_repeat(F.lit(0.0), longest - F.size("v")))).otherwise(F.col("v")))


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, dims: int = 8, miss: float = 0.05,
            cell_points: int = 2048, cell_max: int = 16_384, sample_rows: int = 65_536, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product, ties to the smaller id.

    ``is_query``: condition on ``vec_id``; candidates are all rows but the
    query's own id.
    """
    spark = vectors.sparkSession
    rows = stage_table(usable(vectors, id_col, vec_col), "ann-rows")
    points = stage_table(_points(rows, k), "ann-points")
    n, norm2 = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], empty)
    share = min(1.0, 1.2 * sample_rows / n)
    taken = points.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else points
    sample = _vectors(taken.select("v").limit(sample_rows).toArrow().column(0).combine_chunks())   # only the splits are fitted on it
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / cell_points)))), int(np.log2(max(1, len(sample) / 16)))))
    space = fit_space(sample, float(norm2), dims, depth, seed)
    chi2 = chi2_quantile(1 - miss, dims)
    shared = spark.sparkContext.broadcast(space)   # at most sample_rows / 16 cells

    located = stage_table(_locate(points, shared), "ann-located")
    counts = located.groupBy("cell").agg(F.count("*").alias("c"))
    parts = counts.select("cell", F.ceil(F.col("c") / cell_max).cast("int").alias("parts"))   # one row a cell
    indexed = located.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    indexed = stage_table(indexed, "ann-index")
    tasks = parts.agg(F.sum("parts")).first()[0]   # about a cell part a task: the work is in the search, not in the bytes

    # one query a distinct (id, vector)
    queries = stage_table(rows.where(is_query).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v"), "ann-queries")
    home = _home(queries, shared).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    first = stage_table(_visit(indexed, home.withColumn("floor", F.lit(float("-inf"))), shared, k, chi2, tasks), "ann-first")
    bound = _top(first, k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    away = _others(queries.join(bound, "query", "left").select("query", "query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), shared, chi2)
    away = away.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    second = _visit(indexed, away, shared, k, chi2, tasks)
    return _top(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids; a vector's copies are cut down in two steps.

    The first step ranks within salted groups, so a vector that a third of the
    rows hold is spread.
    """
    pair = rows.dropDuplicates(["vec_id", "v"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = pair.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))


def _locate(points: DataFrame, shared) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                cell = shared.value.cell(shared.value.lift(_vectors(b.column(0))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype("i4"))], names=["v", "ids", "cell"])
    return points.select("v", "ids").mapInArrow(run, "v array<double>, ids array<bigint>, cell int")


def _home(queries: DataFrame, shared) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                cell = shared.value.cell(shared.value.project_queries(_vectors(b.column(2))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("i4"))], names=["query", "query_id", "v", "cell"])
    return queries.select("query", "query_id", "v").mapInArrow(run, "query bigint, query_id bigint, v array<double>, cell int")


def _others(queries: DataFrame, shared, chi2: float) -> DataFrame:
    """The cells, besides the home cell, whose box passes the chi-square test for the query's bound."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):   # a block of queries against the boxes
                c = b.slice(at, 64)
                x = _vectors(c.column(2))
                floor = c.column(3).to_numpy(zero_copy_only=False)
                s = shared.value
                gap = s.box_gap2(s.project_queries(x))
                far = np.maximum(s.norm2 + (x * x).sum(axis=1) - 2 * floor, 0)
                go = gap <= chi2 * far[:, None]
                go[np.arange(len(x)), s.cell(s.project_queries(x))] = False
                i, cell = np.nonzero(go)
                if len(i):
                    yield pa.RecordBatch.from_arrays([*(c.column(k).take(pa.array(i)) for k in range(3)), pa.array(floor[i]),
                                                      pa.array(cell.astype("i4"))], names=["query", "query_id", "v", "floor", "cell"])
    return queries.select("query", "query_id", "v", "floor").mapInArrow(run, "query bigint, query_id bigint, v array<double>, floor double, cell int")


def _visit(indexed: DataFrame, asked: DataFrame, shared, k: int, chi2: float, tasks: int) -> DataFrame:
    """Candidates (query, query_id, ids, score, own) of each query in the cell parts that it asks; own: the point is the query's vector.

    A part's points come first in the sorted stream and are indexed; its
    queries follow and pass in blocks.
    """
    none = F.lit(None)
    stream = (indexed.select("cell", "part", none.cast("bigint").alias("query"), "v", "ids", none.cast("double").alias("floor"), none.cast("bigint").alias("query_id"))
              .unionByName(asked.select("cell", "part", "query", "v", none.cast("array<bigint>").alias("ids"), "floor", "query_id"))
              .repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", F.col("query").asc_nulls_first()))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, now, held, index = shared.value, None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy().astype("i8") << 32 | b.column(1).to_numpy()
            asks = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(asks.astype("i1")) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if key[i] != now:
                    now, held, index = key[i], [], None
                piece = b.slice(i, j - i)
                if not asks[i]:
                    held.append((_vectors(piece.column(3)), piece.column(4)))
                    continue
                if not held:
                    continue
                if index is None:
                    x = np.concatenate([h[0] for h in held])
                    ids = pa.concat_arrays([h[1] for h in held])
                    leaves = Leaves(space.lift(x))
                    index = leaves, x[leaves.rows], ids.take(pa.array(leaves.rows))
                leaves, x, ids = index
                q = _vectors(piece.column(3))
                pq, floor = space.project_queries(q), piece.column(5).to_numpy(zero_copy_only=False)
                names, called = (piece.column(n).to_numpy(zero_copy_only=False).astype("i8") for n in (2, 6))
                for at in range(0, len(q), BLOCK):
                    c = slice(at, at + BLOCK)
                    # one more than k: the query's own vector may be among them
                    who, rows, s = search(leaves, x, q[c], pq[c], k + 1, chi2, space.norm2 + (q[c] * q[c]).sum(axis=1), floor[c])
                    if len(who):
                        own = (x[rows] == q[c][who]).all(axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(names[c][who]), pa.array(called[c][who]), ids.take(pa.array(rows)), pa.array(s),
                                                          pa.array(own)], schema=schema)

    return stream.mapInArrow(run, "query bigint, query_id bigint, ids array<bigint>, score double, own boolean")


def _top(found: DataFrame, k: int) -> DataFrame:
    rows = found.select("query", "query_id", F.explode("ids").alias("vec_id"), "score", "own").where(~(F.col("own") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")
