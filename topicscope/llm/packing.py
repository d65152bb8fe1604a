"""Best-fit packing of token sequences by hierarchical residual packing.

Every input partition tokenises its documents, cuts the long ones into pieces
of the capacity (the first piece takes the remainder) and packs the rest best
fit, longest first.  Bins that are nearly full are emitted; underfull bins
become items of the next round, in fewer partitions, dealt by a hash, until
one partition is left or a round saves almost nothing.  A round's partitions
hold a fixed number of bins each, so no task grows with the input; every
round is a written table.  Bins carry their pieces (at most the capacity).

Best fit takes constant time an item: bins are stacked by free space, and the
smallest sufficient space is the lowest set bit of a mask.

Defined results: a null or empty text is its end id alone; a null id or a
repeated row is packed like any other row; an empty table gives no rows; other
columns are not read.  Equal lengths are ordered by id, piece and checksum, so
a rerun over the same partitions packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import in_slices, stage_table

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("open", pa.bool_()), ("items", pa.list_(ITEM))])
BIN_DDL = ("sequence_id bigint, fill int, open boolean, items array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,"
           "ids_crc32:bigint,offset:bigint>>")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin number of each item, items in the given order."""
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n, out = 0, 0, []
    for length in lengths:
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = spaces[free].pop()
            if not spaces[free]:
                mask &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        out.append(b)
        free -= length
        if free:
            spaces[free].append(b)
            mask |= 1 << free
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only documents over the capacity are cut."""
    head = n % capacity or capacity
    return [(0, n)] if n <= capacity else [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def _id(stage: int, part: int, n: np.ndarray) -> np.ndarray:
    """Numbers that no other stage, partition or bin has."""
    return (stage << 56) + (part << 32) + n.astype("i8")


def _grouped(rows: pa.StructArray, bins: np.ndarray, lengths: np.ndarray, shifts: np.ndarray | None, counts: np.ndarray | None,
             stage: int, part: int, first: int, capacity: int, slack: int) -> pa.RecordBatch:
    """Bins with their items, in packing order.

    ``bins`` and ``lengths`` are per packed unit; ``counts`` gives the rows of a
    unit (one by default), ``rows`` in unit order.
    """
    order = np.argsort(bins, kind="stable")
    n = int(bins.max()) + 1
    counts = np.ones(len(bins), "i8") if counts is None else counts
    ends = np.cumsum(lengths[order])
    in_bin = np.bincount(bins, minlength=n)
    last = np.cumsum(in_bin)
    fill = np.diff(np.concatenate([[0], ends[last - 1]]))
    unit_at = ends - lengths[order] - np.repeat(np.concatenate([[0], ends[last - 1]])[:-1], in_bin)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    take = np.concatenate([np.arange(starts[u], starts[u] + counts[u]) for u in order]) if counts.max() > 1 else order
    got = rows.take(pa.array(take))
    fields = [got.field(i) for i in range(got.type.num_fields)]
    offset = np.repeat(unit_at, counts[order]) + (shifts[take] if shifts is not None else 0)
    items = pa.StructArray.from_arrays([*fields[:5], pa.array(offset.astype("i8"))], fields=list(ITEM))
    per_bin = np.bincount(np.repeat(bins[order], counts[order]), minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype("i4")), items)
    return pa.RecordBatch.from_arrays([pa.array(_id(stage, part, np.arange(first, first + n))), pa.array(fill.astype("i4")),
                                       pa.array(capacity - fill > slack), lists.cast(BIN.field("items").type)], schema=BIN)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, end_id: int, slack: int, flush: int = 200_000) -> DataFrame:
    """Tokenise, cut and pack inside each input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, part = encoder(tokenizer), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        made, held = 0, []

        def packed():
            nonlocal made, held
            held.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))
            lengths = np.array([r[3] for r in held], "i8")
            bins = np.array(best_fit(lengths.tolist(), capacity), "i8")
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), list(ITEM)[:5])], fields=list(ITEM)[:5])
            out = _grouped(rows, bins, lengths, None, None, 0, part, made, capacity, slack)
            made, held = made + out.num_rows, []
            return out

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(in_slices(b.column(1)))):
                raw = ids + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    held.append((doc_id, k, s, n, zlib.crc32(raw[4 * s:4 * (s + n)])))
            if len(held) >= flush:
                yield packed()
        if held:
            yield packed()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, BIN_DDL)


def merge_round(bins: DataFrame, stage: int, parts: int, capacity: int, slack: int) -> DataFrame:
    """Pack underfull bins as items, ``parts`` partitions dealt by a hash of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]   # a bounded number of bins
        if not held:
            return
        got = pa.Table.from_batches(held)
        fill, number = got.column("fill").to_numpy().astype("i8"), got.column("sequence_id").to_numpy()
        order = np.lexsort((number, -fill))
        got = got.take(pa.array(order)).combine_chunks()
        lists = got.column("items").chunk(0) if got.column("items").num_chunks else got.column("items")
        counts = np.diff(lists.offsets.to_numpy()).astype("i8")
        rows = lists.flatten()
        fills = fill[order]
        packed = np.array(best_fit(fills.tolist(), capacity), "i8")
        yield _grouped(rows, packed, fills, rows.field(5).to_numpy(), counts, stage, TaskContext.get().partitionId(), 0, capacity, slack)

    return bins.repartition(parts, F.xxhash64(F.lit(stage), "sequence_id")).mapInArrow(run, BIN_DDL)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
         slack: int = 4, bins_per_task: int = 50_000, least_gain: float = 0.002, max_rounds: int = 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    now = stage_table(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, slack=slack), "packing")
    done = now.where(~F.col("open"))
    open_ = now.where("open")
    left = open_.count()
    for stage in range(1, max_rounds + 1):
        if left == 0:
            break
        parts = -(-left // bins_per_task)
        now = stage_table(merge_round(open_, stage, parts, capacity, slack), "packing")
        made, still = now.agg(F.count("*"), F.sum(F.col("open").cast("long"))).first()
        if parts == 1 or left - made < least_gain * left:
            done, left = done.unionByName(now), 0
        else:
            done, open_, left = done.unionByName(now.where(~F.col("open"))), now.where("open"), still or 0
    if left:
        done = done.unionByName(open_)
    out = done.select("sequence_id", F.explode("items").alias("i"))
    return out.select("i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset")
