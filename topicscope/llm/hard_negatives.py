"""Hard negatives by exact integer inner products, several candidates to one multiplication.

Components are scaled to integers (floor of ``scale`` x component).  Kronecker
packing: the same component of several candidates, biased to be non-negative,
stands in separated bit fields of one wide integer; one product with the
anchor's biased component serves them all, and the sum over components holds
each candidate's biased inner product in its field, from which the bias terms
are taken off again.  A field has as many bits as the table's largest component
range needs, so no field runs into the next; fields fill 64-bit lanes, and
where one field alone needs more, Python integers of any width.

Plan: rows are dealt into blocks of about ``block_rows`` by a hash of the row,
every anchor visits every block (a stated set of anchors against all rows, in
blocks), and a block's answers are its own best few, which merge by rank:

1. positives: an anchor meets its label's part of each block, the best
   ``n_pos`` of all blocks stay;
2. negatives: it meets the other labels with those positives' scores, the best
   ``n_neg`` in each positive's band of every block, then of all blocks.

A block's rows come first in the sorted stream of its task and are packed;
anchors pass in batches, so memory is a block and a batch of scores.  A label or
a vector that a third of the rows share is spread over all blocks by the hash.

Defined results: rows with a null label, a null vector, or a component that is
null or not finite (also after scaling) take no part; an empty vector does (all
its scores are 0), and beyond the end of the shorter of two vectors components
count as 0.  Every row counts, repeated rows too: a repeat of the anchor's row
is another row.  A null id is no anchor and stands last in ties; rows equal in
score and id stand in the order of the staged table.  No positives, or none in the band, give no
rows; an empty table gives none; other columns are ignored, whatever their
names.  A score beyond a long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Anchors scored together against a block.
BATCH = 64


class Packed:
    """A block's candidates, packed for products with anchors whose components lie in the same range [low, high]."""

    def __init__(self, x: np.ndarray, low: int, high: int):
        self.n, self.d = x.shape
        self.bias = -low
        self.bits = max(1, (max(1, self.d) * (high - low) ** 2).bit_length())
        self.lane = self.bits <= 63
        self.fields = 63 // self.bits if self.lane else 4
        kind = "u8" if self.lane else object
        c = np.zeros((-(-self.n // self.fields) * self.fields, self.d), kind)
        c[:self.n] = _integers(x + float(self.bias) if self.lane else x, self.lane) + (0 if self.lane else self.bias)
        self.sums = c.sum(axis=1)
        c = c.reshape(-1, self.fields, self.d)
        self.words = c[:, 0].copy()
        for f in range(1, self.fields):
            self.words |= c[:, f] << (np.uint64(f * self.bits) if self.lane else f * self.bits)

    def scores(self, a: np.ndarray, start: int, end: int) -> np.ndarray:
        """Inner products of anchors (rows of ``a``) with candidates start..end-1."""
        a = _integers(a + float(self.bias), True) if self.lane else _integers(a, False) + self.bias
        lo, hi = start // self.fields, -(-end // self.fields)
        product = a @ self.words[lo:hi].T
        mask = (1 << self.bits) - 1
        out = np.empty((len(a), hi - lo, self.fields), "i8" if self.lane else object)
        for f in range(self.fields):
            if self.lane:
                out[:, :, f] = (product >> np.uint64(f * self.bits)) & np.uint64(mask)
            else:
                out[:, :, f] = (product >> (f * self.bits)) & mask
        at = lo * self.fields
        out = out.reshape(len(a), -1)[:, start - at:end - at]
        # sum (x + b)(y + b) = sum x y + b (sum (x + b) + sum (y + b)) - d b^2
        sums_a, sums_c = a.sum(axis=1), self.sums[start:end]
        if self.lane:
            sums_a, sums_c = sums_a.astype("i8"), sums_c.astype("i8")
        return out - self.bias * (sums_a[:, None] + sums_c[None]) + self.d * self.bias * self.bias


def _integers(x: np.ndarray, lane: bool) -> np.ndarray:
    """Whole numbers held as doubles, as integers (exact)."""
    if lane:
        return x.astype("u8")
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _scaled(vectors: pa.Array, scale: int, d: int) -> np.ndarray:
    """floor(scale x component) as doubles; shorter vectors are filled up with zeros."""
    ends = np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype("i8"))
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    if len(vectors) and ends[-1] == len(vectors) * d and (np.diff(ends, prepend=0) == d).all():
        return flat.reshape(len(vectors), d)
    out = np.zeros((len(vectors), d))
    for i, (s, e) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        out[i, :e - s] = flat[s:e]
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller position, best first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        at = np.concatenate([above, np.flatnonzero(scores == kth)[:k - len(above)]])
    else:
        at = np.arange(len(scores))
    return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], i)), "i8")


class Block:
    """One block's candidates, sorted by label; within a label by id, nulls last."""

    def __init__(self, held: list[pa.RecordBatch], scale: int, d: int, low: int, high: int):
        t = pa.Table.from_batches(held)
        self.row = t.column("row").to_numpy()
        self.ids = t.column("vec_id").combine_chunks()
        self.runs, at = {}, 0
        for label, run in groupby(t.column("label").to_pylist()):
            n = sum(1 for _ in run)
            self.runs[label] = at, at + n
            at += n
        self.packed = Packed(np.concatenate([_scaled(b.column("v"), scale, d) for b in held]), low, high)
        ids = self.ids.to_numpy(zero_copy_only=False).astype("f8")   # order only: nulls become nan and sort last
        exact = self.ids.fill_null(np.iinfo("i8").max).to_numpy()
        self.rank = np.empty(at, "i8")
        self.rank[np.lexsort((self.row, exact, np.isnan(ids)))] = np.arange(at)

    def positives(self, row: np.ndarray, labels: list, x: np.ndarray, k: int) -> Iterator[tuple]:
        """(anchor row, candidate row, id, score) of each anchor's best others of its label."""
        for label in sorted(set(labels) & self.runs.keys()):
            start, end = self.runs[label]
            who = [i for i, one in enumerate(labels) if one == label]
            for i, s in zip(who, self.packed.scores(x[who], start, end)):
                best = [start + j for j in _best(s, k + 1).tolist()]   # one more: the anchor itself may be among them
                for j in [j for j in best if self.row[j] != row[i]][:k]:
                    yield int(row[i]), int(self.row[j]), self.ids[j].as_py(), int(s[j - start])

    def negatives(self, row: np.ndarray, labels: list, x: np.ndarray, wanted: list[list[int]], k: int, low: int, high: int) -> Iterator[tuple]:
        """(anchor row, positive's place, candidate row, id, score) of the best of other labels in each positive's band."""
        scores = self.packed.scores(x, 0, len(self.row))
        for i, (label, marks) in enumerate(zip(labels, wanted)):
            start, end = self.runs.get(label, (0, 0))
            other = np.ones(len(self.row), bool)
            other[start:end] = False
            s = scores[i]
            # the band of one positive is empty or lies between the least lower and the greatest upper bound
            at = np.flatnonzero(other & (100 * s >= low * min(marks)) & (100 * s <= high * max(marks)))
            if not len(at):
                continue
            at = at[np.lexsort((self.rank[at], -s[at]))] if self.packed.lane else np.array(sorted(at.tolist(), key=lambda j: (-s[j], self.rank[j])), "i8")
            for place, mark in enumerate(marks):
                in_band = at[(100 * s[at] >= low * mark) & (100 * s[at] <= high * mark)][:k]
                for j in in_band.tolist():
                    yield int(row[i]), place, int(self.row[j]), self.ids[j].as_py(), int(s[j])


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; vectors keep their element type."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) == float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad)


def _visit(rows: DataFrame, anchors: DataFrame, blocks: int, task, schema: str) -> DataFrame:
    """Each block's rows, then all anchors, through ``task(block rows, anchor batches)``."""
    everywhere = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    marks = F.lit(None).cast("array<bigint>")
    stream = (rows.select("block", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", marks.alias("marks"))
              .unionByName(everywhere.select("block", F.lit(1).alias("kind"), "row", "vec_id", "label", "v",
                                             "marks" if "marks" in anchors.columns else marks.alias("marks")))
              .repartition(blocks, "block").sortWithinPartitions("block", "kind", "label", F.col("vec_id").asc_nulls_last(), "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("block").to_numpy().astype("i8") * 2 + b.column("kind").to_numpy()
            cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if key[i] >> 1 != now:
                    now, held, block = key[i] >> 1, [], None
                if not key[i] & 1:
                    held.append(b.slice(i, j - i))
                    continue
                if held and block is None:
                    block, held = task.block(held), [held[0].slice(0, 1)]
                if block is not None:
                    for at in range(i, j, BATCH):
                        out = list(zip(*task.answer(block, b.slice(at, min(BATCH, j - at)))))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, task.types)], names=task.names)

    return stream.mapInArrow(run, schema)


class _Task:
    def __init__(self, scale: int, d: int, low: int, high: int, k: int, band: tuple[int, int] | None = None):
        self.scale, self.d, self.low, self.high, self.k, self.band = scale, d, low, high, k, band
        place = [] if band is None else [("place", pa.int64())]
        self.names, self.types = zip(("anchor_row", pa.int64()), *place, ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))

    def block(self, held: list[pa.RecordBatch]) -> Block:
        return Block(held, self.scale, self.d, self.low, self.high)

    def answer(self, block: Block, b: pa.RecordBatch) -> Iterator[tuple]:
        row, labels, x = b.column("row").to_numpy(), b.column("label").to_pylist(), _scaled(b.column("v"), self.scale, self.d)
        if self.band is None:
            return block.positives(row, labels, x, self.k)
        return block.negatives(row, labels, x, b.column("marks").to_pylist(), self.k, *self.band)


def mine(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", n_pos: int = 5,
         n_neg: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256, block_rows: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: condition on the column ``vec_id``.  A negative of a positive
    has another label and band[0] x positive <= 100 x negative <= band[1] x positive.
    """
    spark = vectors.sparkSession
    keyed = usable(vectors, id_col, label_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = stage_table(keyed, "negatives-rows")
    whole = F.transform("v", lambda c: c.cast("double") * scale)
    n, d, low, high = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min(whole)), F.max(F.array_max(whole))).first()
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], empty)
    low, high = min(0, int(np.floor(low or 0))), max(0, int(np.floor(high or 0)))
    blocks = -(-n // block_rows)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False))).drop("block")
    args = scale, d, low, high

    found = _visit(rows, anchors, blocks, _Task(*args, n_pos), "anchor_row bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    positives = (found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < n_pos)
                 .groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p")))   # at most n_pos
    asked = stage_table(anchors.join(positives.withColumnRenamed("anchor_row", "row"), "row")
                        .withColumn("marks", F.col("p.score")), "negatives-positives")

    found = _visit(rows, asked, blocks, _Task(*args, n_neg, band), "anchor_row bigint, place bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    negatives = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_neg).withColumnRenamed("vec_id", "negative_id")
    heads = asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "p")
    positive = F.element_at("p", (F.col("place") + 1).cast("int"))
    return negatives.join(heads, "anchor_row").select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", "negative_id",
                                                      positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
