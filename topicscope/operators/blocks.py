"""Documents in blocks with term numbers of their own, joined with a term table block by block.

A block's documents come as packed arrays of numbers; the terms that it uses are
rows (block, term, idx).  Joining a (term, array) table with these rows and
streaming each block's term rows before its documents moves a term's array once
a block, not once a document or token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from topicscope.staging import staged


@dataclass
class Blocks:
    """``docs`` (block, id, idx, n): a document's term numbers and counts as packed int32 and float64; ``uses`` (block, term, idx).

    ``docs`` may have a column ``c`` (array of double) of the documents' own, which is passed on with them.
    Where they are ``short``, ``idx`` and ``n`` take as few bytes a number as a document's numbers need (``shortened``); tasks get them in full.
    """
    docs: DataFrame
    uses: DataFrame
    n: int
    id_type: str
    kept: bool = False
    classes: DataFrame | None = None      # (topic, term, n, df) by block, where the documents have classes
    short: bool = False
    words: DataFrame | None = None        # (term, by), what ``classes`` are read from: a term's classes in one row

    def of(self, ids: DataFrame, id_col: str = "doc_id") -> Blocks:
        """The blocks with the documents of ``ids`` only; their terms may be of others too."""
        return Blocks(self.docs.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi").select(*self.docs.columns), self.uses, self.n, self.id_type, short=self.short)

    def keep(self) -> Blocks:
        """Documents dealt out by block once and kept there, for work of many rounds (``each_kept_block``)."""
        docs = self.docs.repartition(self.n, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
        return Blocks(docs, self.uses, self.n, self.id_type, True, short=self.short)

    @property
    def full(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """What makes documents into those that tasks read: ``idx`` int32, ``n`` float64."""
        return in_full if self.short else lambda b: b


def in_full(b: pa.RecordBatch) -> pa.RecordBatch:
    cols = {"idx": [np.cumsum(lengthened(x), dtype="<i4").tobytes() for x in b.column("idx").to_pylist()],
            "n": [lengthened(x).astype("<f8").tobytes() for x in b.column("n").to_pylist()]}
    return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.binary()) if c in cols else b.column(c) for c in b.schema.names], names=b.schema.names)


def shortened(x: np.ndarray, cuts: list[int]) -> list[bytes]:
    """The numbers between each two of ``cuts`` in as few bytes as the greatest of them needs: their width, then first bytes, second bytes and so on."""
    flat = x.astype("<u8")
    most = np.maximum.reduceat(flat, cuts[:-1]) if len(cuts) > 1 else flat[:0]
    widths = (1 + sum((most >> np.uint64(bits) > 0).astype("i8") for bits in range(8, 64, 8))).tolist()
    flat = flat.view("u1").reshape(-1, 8)
    return [bytes([w]) + flat[a:b, :w].T.tobytes() for w, a, b in zip(widths, cuts, cuts[1:])]


def lengthened(raw: bytes) -> np.ndarray:
    """The numbers of ``shortened``."""
    if not raw:
        return np.zeros(0, "<u4")
    kind = "<u4" if raw[0] <= 4 else "<u8"
    out = np.zeros(((len(raw) - 1) // raw[0], int(kind[-1])), "u1")
    out[:, :raw[0]] = np.frombuffer(raw, "u1", offset=1).reshape(raw[0], -1).T
    return out.view(kind)[:, 0]


#: A block of fewer cells is not split further for the sake of parallel tasks.
LEAST_CELLS = 1 << 20
#: Pairs x dims of a block of a grid at most (about).
GRID_CELLS = 1 << 27


def _n_blocks(spark, total: int, k: int, cells: int) -> int:
    """As many as ``cells`` asks for, and enough to keep all cores busy."""
    return max(1, -(-total * k // cells), min(4 * spark.sparkContext.defaultParallelism, total * k // LEAST_CELLS))


def even_labels(spark, n: int) -> list[int]:
    """``n`` int keys, one for each of ``n`` hash partitions, so that a shuffle by them gives each task one."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = {r["at"]: r["id"] for r in spark.range(32 * n).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()}   # n rows
    rest = iter(range(32 * n, 33 * n))
    return [found[i] if i in found else next(rest) for i in range(n)]


def labelled(spark, number: Column, n: int) -> Column:
    """The label of part ``number`` of ``n``."""
    return F.get(F.array(*[F.lit(x) for x in even_labels(spark, n)]), number.cast("int"))


def dealt(spark, key: str, n: int) -> Column:
    """The label of one of ``n`` parts, by a hash of ``key``."""
    return labelled(spark, F.pmod(F.xxhash64(key), F.lit(n)), n)


def block_pairs(dtm: DataFrame, k: int, cells: int, id_col: str = "doc_id") -> Blocks:
    """Blocks of the documents of a (id, term, n) table, about ``cells`` / ``k`` pairs each; a document's terms are sorted."""
    rows = dtm.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(F.struct("term", F.col("n").cast("bigint").alias("n")))).alias("tn"))
    return _blocked(rows, _n_blocks(dtm.sparkSession, dtm.count(), k, cells), dtm.schema[id_col].dataType.simpleString())


def grid_size(pairs: int, terms: int, docs: int, dims: int, cells: int, parallel: int, most: int = GRID_CELLS) -> tuple[int, int]:
    """(parts of the terms, parts of the documents) of a grid of blocks.

    A part of the terms has at most about ``cells`` numbers; a block has at most about ``most`` pairs x dims and
    there are enough for all cores.  Each document moves an array once a part of the terms, each term once a part of
    the documents: the shape is the one of the fewest arrays.
    """
    n = max(1, -(-pairs * dims // most), min(4 * parallel, pairs * dims // LEAST_CELLS))
    parts = max(1, -(-terms * dims // cells), min(n, round((n * terms / max(1, docs)) ** 0.5)))
    return parts, max(1, -(-n // parts))


def block_grid(dtm: DataFrame, dims: int, cells: int, id_col: str = "doc_id") -> Blocks:
    """Blocks of a part of the documents and a part of the terms, for arrays of ``dims`` numbers a term and a document.

    A document has a row in each block that holds some of its terms, a term is used by one block a part of the documents.
    """
    spark = dtm.sparkSession
    size = dtm.agg(F.count(F.lit(1)), F.approx_count_distinct("term"), F.approx_count_distinct(id_col)).first()   # only for the shape
    parts, cols = grid_size(*size, max(1, dims), cells, spark.sparkContext.defaultParallelism)
    rows = (dtm.groupBy(F.col(id_col).alias("id"), F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("term", F.col("n").cast("bigint").alias("n")))).alias("tn")))
    at = F.col("part") * cols + F.pmod(F.xxhash64("id"), F.lit(cols))
    return _in_blocks(rows, labelled(spark, at, parts * cols), parts * cols, dtm.schema[id_col].dataType.simpleString())


def block_in_place(dtm: DataFrame, pairs: int, id_col: str = "doc_id") -> Blocks:
    """Blocks of about ``pairs`` pairs, each of documents that lie together: nothing moves if ``dtm`` is dealt out by its ids."""
    rows = (dtm.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("term", F.col("n").cast("bigint").alias("n"))).alias("tn"))
            .select(F.spark_partition_id().alias("part"), "id", "tn"))
    id_type = dtm.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = 0, 0
        for b in batches:
            sizes = b.column("tn").value_lengths().to_numpy()
            out = np.empty(len(b), "i8")
            for i, size in enumerate(sizes.tolist()):
                if held and held + size > pairs:
                    block, held = block + 1, 0
                held += size
                out[i] = block
            yield pa.RecordBatch.from_arrays([pa.array(b.column("part").to_numpy().astype("i8") << 32 | out), b.column("id"), b.column("tn")], names=["block", "id", "tn"])

    return _encoded(rows.mapInArrow(number, f"block bigint, id {id_type}, tn array<struct<term:string,n:bigint>>"), None, id_type)


def block_sequences(tokens: DataFrame, id_col: str, token_col: str, k: int, cells: int) -> Blocks:
    """Blocks of token arrays in order (``n`` is empty), at most about ``cells`` / ``k`` tokens each, made where the rows lie."""
    id_type, most = tokens.schema[id_col].dataType.simpleString(), max(1, cells // k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, held, id_kind = TaskContext.get().partitionId() << 32, {}, 0, None
        names = ["block", "id", "idx", "n", "term", "at"]

        def terms() -> Iterator[pa.RecordBatch]:
            words = list(number)
            for i in range(0, len(words), 50_000):
                m = len(words[i:i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block, "i8")), pa.nulls(m, id_kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                                                  pa.array(words[i:i + 50_000]), pa.array(np.arange(i, i + m, dtype="i4"))], names=names)

        for whole in batches:
            whole = whole.filter(pc.fill_null(pc.greater(pc.list_value_length(whole.column("tokens")), 0), False))    # in Spark, a filter would have the texts tokenised twice
            if not whole.num_rows:
                continue
            id_kind = whole.schema.field("id").type
            ends, at = np.append(0, np.cumsum(whole.column("tokens").value_lengths().to_numpy().astype("i8"))), 0
            while at < len(whole):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + min(COUNTED, most), "right")) - 1)     # a row is not cut
                b, cuts = whole.slice(at, to - at), (ends[at:to + 1] - ends[at]).tolist()
                if held and held + cuts[-1] > most:
                    yield from terms()
                    block, number, held = block + 1, {}, 0
                code = b.column("tokens").flatten().dictionary_encode()
                local = np.array([number.setdefault(w, len(number)) for w in code.dictionary.to_pylist()], "<i4")
                idx, m, held, at = local[code.indices.to_numpy()], len(b), held + cuts[-1], to
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block, "i8")), b.column("id"), pa.array([idx[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary()),
                                                  pa.array([b""] * m, pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32())], names=names)
        yield from terms()

    rows = tokens.select(F.col(id_col).alias("id"), F.col(token_col).alias("tokens"))
    out, blocks = _evenly(staged(rows.mapInArrow(run, f"block bigint, id {id_type}, idx binary, n binary, term string, at int"), "blocks"))
    return Blocks(out.where("idx IS NOT NULL").select("block", "id", "idx", "n"), out.where("term IS NOT NULL").select("block", "term", F.col("at").alias("idx")), blocks, id_type)


class BlockTask:
    """What is done with one block: built from its term rows, then given its documents in slices."""

    def __init__(self, held: list[pa.RecordBatch]):
        """``held``: rows (term, at, c), ``c`` null where the table lacks the term."""

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """``b``: rows (id, idx, n, c), ``c`` null unless the documents have arrays of their own."""
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _evenly(out: DataFrame) -> tuple[DataFrame, int]:
    """Blocks numbered part << 32 | place in the part, by labels that give each a hash partition of its own; how many they are."""
    part = F.shiftright("block", 32)
    held = {r["part"]: r["n"] for r in out.where("at = 0").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a part
    offsets = np.concatenate([[0], np.cumsum([held.get(i, 0) for i in range(max(held, default=0) + 1)])])
    blocks = max(1, int(offsets[-1]))
    number = F.get(F.array(*[F.lit(int(x)) for x in offsets]), part.cast("int")) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF))
    return out.withColumn("block", labelled(out.sparkSession, number, blocks)), blocks


#: Tokens that are counted at once.
COUNTED = 1 << 18


class Counter:
    """Documents that come in order of (id, topic) with their terms, made into blocks of about ``pairs`` pairs.

    Rows of one id are one document; a class counts a term once a document (``df``).
    """

    def __init__(self, pairs: int, first: int):
        self.pairs, self.block, self.names = pairs, first - 1, ["block", "id", "idx", "n", "term", "at", "by"]
        self._next()

    def _next(self) -> None:
        self.block += 1
        self.number, self.topics, self.by, self.held = {}, {}, [], 0

    def add(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """``t``: whole documents (id, topic, terms)."""
        t = t.combine_chunks().to_batches()[0] if t.num_rows else None
        if t is None:
            return
        doc = _steps([t.column("id")])
        sizes = pc.fill_null(pc.list_value_length(t.column("terms")), 0).to_numpy(zero_copy_only=False).astype("i8")
        starts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))      # a document is not cut
        ends, at = np.concatenate([[0], np.cumsum(sizes)])[starts], 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + min(COUNTED, self.pairs), "right")) - 1)
            yield from self._count(t.slice(starts[at], starts[to] - starts[at]), sizes[starts[at]:starts[to]])
            at = to

    def _count(self, t: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = t.column("terms").flatten()
        if not len(flat):
            return
        if self.held and self.held + len(flat) > self.pairs:
            yield from self.end()
            self._next()
        doc, group = _steps([t.column("id")]), _steps([t.column("id"), t.column("topic")])
        code = flat.dictionary_encode()
        local = np.array([self.number.setdefault(w, len(self.number)) for w in code.dictionary.to_pylist()], "i8")
        key, n = np.unique(np.repeat(group, sizes) << 32 | local[code.indices.to_numpy()], return_counts=True)
        of, term = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(group, prepend=-1))                       # a group's first row
        names = t.column("topic").take(pa.array(first)).to_pylist()
        topic = np.array([self.topics.setdefault(x, len(self.topics)) for x in names], "i8")
        self._class_counts(term << 32 | topic[of], n, np.ones(len(n), "i8"))
        if len(first) > doc[-1] + 1:                                             # an id under several topics
            key, where = np.unique(doc[first][of] << 32 | term, return_inverse=True)
            of, term, n = key >> 32, key & 0xFFFFFFFF, np.bincount(where, n).astype("i8")
        self.held += len(term)
        docs, cuts = np.unique(of, return_index=True)
        ids = t.column("id").take(pa.array(np.flatnonzero(np.diff(doc, prepend=-1))[docs]))
        step = np.diff(term, prepend=0)
        step[cuts] = term[cuts]                                                  # a document's first is whole, others are steps
        m, cuts = len(docs), [*cuts.tolist(), len(of)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.block, "i8")), ids, pa.array(shortened(step, cuts), pa.binary()),
                                          pa.array(shortened(n, cuts), pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()),
                                          pa.nulls(m, self.by_type(t))], names=self.names)

    def by_type(self, t: pa.RecordBatch) -> pa.DataType:
        self.id_kind, self.topic_kind = t.schema.field("id").type, t.schema.field("topic").type
        return pa.list_(pa.struct([("topic", self.topic_kind), ("n", pa.int64()), ("df", pa.int64())]))

    def _class_counts(self, key: np.ndarray, n: np.ndarray, df: np.ndarray) -> None:
        self.by.append((key, n, df))
        if sum(len(k) for k, *_ in self.by) > 1 << 22:
            self.by = [self._added()]

    def _added(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, df = (np.concatenate(x) for x in zip(*self.by))
        key, where = np.unique(keys, return_inverse=True)
        return key, np.bincount(where, n).astype("i8"), np.bincount(where, df).astype("i8")

    def end(self) -> Iterator[pa.RecordBatch]:
        """The block's terms."""
        if not self.number:
            return
        key, n, df = self._added()
        words, topics = list(self.number), pa.array(list(self.topics), self.topic_kind)
        cuts = np.searchsorted(key >> 32, np.arange(len(words) + 1))
        for i in range(0, len(words), 20_000):
            part = words[i:i + 20_000]
            m, a, b = len(part), int(cuts[i]), int(cuts[i + len(part)])
            by = pa.StructArray.from_arrays([topics.take(pa.array(key[a:b] & 0xFFFFFFFF)), pa.array(n[a:b]), pa.array(df[a:b])], names=["topic", "n", "df"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.block, "i8")), pa.nulls(m, self.id_kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                                              pa.array(part, pa.string()), pa.array(np.arange(i, i + m, dtype="i4")),
                                              pa.ListArray.from_arrays(pa.array((cuts[i:i + m + 1] - a).astype("i4")), by)], names=self.names)


def _steps(columns: list[pa.Array]) -> np.ndarray:
    """The number of each row's run of equal values, from 0; nulls are equal."""
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
    new = np.zeros(len(codes[0]), bool)
    for c in codes:
        new[1:] |= np.diff(c) != 0
    return np.cumsum(new).astype("i8")


def block_terms(rows: DataFrame, pairs: int = 1 << 21) -> Blocks:
    """Blocks of documents (id, topic, terms) with their ``classes``, made where the documents lie.

    The rows of an id lie in one partition, in order of (id, topic).  A document's
    terms are counted in its task: no row a document and term is ever made.
    """
    id_type, topic_type = (rows.schema[c].dataType.simpleString() for c in ("id", "topic"))
    return counted_blocks(rows.select("id", "topic", "terms"), lambda batches: batches, id_type, topic_type, pairs)


def counted_blocks(rows: DataFrame, terms: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], id_type: str, topic_type: str, pairs: int, documents: bool = True) -> Blocks:
    """``block_terms`` of the (id, topic, terms) that ``terms`` makes of a task's batches; without ``documents``, only their terms and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b for b in count(batches) if documents or not b.column("term").null_count)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, rest = Counter(pairs, TaskContext.get().partitionId() << 32), None
        for b in terms(batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = int(np.flatnonzero(np.diff(_steps([t.column("id").combine_chunks()]), prepend=-1))[-1])   # its document may go on
            rest = t.slice(last)
            yield from counter.add(t.slice(0, last))
        if rest is not None:
            yield from counter.add(rest)
        yield from counter.end()

    out = staged(rows.mapInArrow(
        run, f"block bigint, id {id_type}, idx binary, n binary, term string, at int, by array<struct<topic:{topic_type},n:bigint,df:bigint>>"), "blocks")
    out, blocks = _evenly(out)
    words = out.where("term IS NOT NULL")
    return Blocks(out.where("idx IS NOT NULL").select("block", "id", "idx", "n"), words.select("block", "term", F.col("at").alias("idx")), blocks, id_type,
                  classes=by_class(words), short=True, words=words.select("term", "by"))


def by_class(words: DataFrame) -> DataFrame:
    """(topic, term, n, df) of rows (term, by)."""
    return words.select("term", F.explode("by").alias("b")).select("b.topic", "term", "b.n", "b.df")


class HeldPairs(BlockTask):
    """(id, term, n) of the pairs whose term the table has."""

    def __init__(self, held: list[pa.RecordBatch]):
        at, terms = np.concatenate([b.column("at").to_numpy() for b in held]), pa.concat_arrays([b.column("term") for b in held])
        self.row, self.terms = np.full(int(at.max()) + 2, -1), terms     # the last stands for all terms beyond
        self.row[at] = np.arange(len(at))

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idx, n = ([np.frombuffer(x, kind) for x in b.column(c).to_pylist()] for c, kind in (("idx", "<i4"), ("n", "<f8")))
        row = self.row[np.minimum(np.concatenate(idx), len(self.row) - 1)]
        some, doc = row >= 0, np.repeat(np.arange(len(idx)), [len(i) for i in idx])
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc[some])), self.terms.take(pa.array(row[some])), pa.array(np.concatenate(n)[some].astype("i8"))],
                                         names=["id", "term", "n"])


class TermSums(BlockTask):
    """(term, n): sums over a block's documents."""

    def __init__(self, held: list[pa.RecordBatch]):
        self.at, self.terms = np.concatenate([b.column("at").to_numpy() for b in held]), pa.concat_arrays([b.column("term") for b in held])
        self.n = np.zeros(int(self.at.max()) + 1)

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idx, n = (np.concatenate([np.frombuffer(x, kind) for x in b.column(c).to_pylist()]) for c, kind in (("idx", "<i4"), ("n", "<f8")))
        some = idx < len(self.n)
        self.n += np.bincount(idx[some], n[some], len(self.n))
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.n[self.at] > 0)
        yield pa.RecordBatch.from_arrays([self.terms.take(pa.array(some)), pa.array(self.n[self.at][some].astype("i8"))], names=["term", "n"])


def term_totals(blocks: Blocks, terms: DataFrame) -> DataFrame:
    """(term, tf): the counts in the blocks' documents of those of the given ``terms`` that they hold."""
    table = terms.select("term").withColumn("c", F.array().cast("array<double>"))
    return each_block(blocks, table, TermSums, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("tf"))


def held_pairs(blocks: Blocks, terms: DataFrame, few: bool = False) -> DataFrame:
    """(id, term, n): the document-term rows of the given ``terms`` only; where they are ``few``, the blocks' term lists do not move."""
    table = terms.select("term").distinct().withColumn("c", F.array().cast("array<double>"))
    return each_block(blocks, F.broadcast(table) if few else table, HeldPairs, f"id {blocks.id_type}, term string, n bigint")


def _blocked(rows: DataFrame, blocks: int, id_type: str) -> Blocks:
    return _in_blocks(rows, dealt(rows.sparkSession, "id", blocks), blocks, id_type)


def _in_blocks(rows: DataFrame, block: Column, blocks: int, id_type: str) -> Blocks:
    rows = (rows.withColumn("block", block)
            .repartition(blocks, "block").sortWithinPartitions("block", "id").select("block", "id", "tn"))
    return _encoded(rows, blocks, id_type)


def _encoded(rows: DataFrame, blocks: int | None, id_type: str) -> Blocks:
    """The written blocks of rows (block, id, tn) that come block by block; without ``blocks`` they are counted."""
    block_type = rows.schema["block"].dataType.simpleString()
    kind = "i4" if block_type == "int" else "i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, id_kind = None, {}, None
        names = ["block", "id", "idx", "n", "term", "at"]

        def terms() -> Iterator[pa.RecordBatch]:
            words = list(number)
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, now, kind)), pa.nulls(m, id_kind), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()),
                                                  pa.array(part), pa.array(np.arange(i, i + m, dtype="i4"))], names=names)

        for whole in batches:
            if not whole.num_rows:
                continue
            id_kind, block = whole.schema.field("id").type, whole.column("block").to_numpy()
            cuts = (np.flatnonzero(np.diff(block)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, whole.num_rows]):
                if block[i] != now:
                    if number:
                        yield from terms()
                    now, number = int(block[i]), {}
                b = whole.slice(i, j - i)
                flat = b.column("tn").flatten()
                code = flat.field("term").dictionary_encode()
                local = np.array([number.setdefault(w, len(number)) for w in code.dictionary.to_pylist()], "<i4")
                idx, n = local[code.indices.to_numpy()], flat.field("n").to_numpy().astype("<f8")
                ends = np.cumsum(b.column("tn").value_lengths().to_numpy())
                at = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                m = len(b)
                yield pa.RecordBatch.from_arrays([b.column("block"), b.column("id"), pa.array([idx[s:e].tobytes() for s, e in at], pa.binary()),
                                                  pa.array([n[s:e].tobytes() for s, e in at], pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32())],
                                                 names=names)
        if number:
            yield from terms()

    out = staged(rows.mapInArrow(run, f"block {block_type}, id {id_type}, idx binary, n binary, term string, at int"), "blocks")
    if blocks is None:
        blocks = max(1, out.where("at = 0").count())
    return Blocks(out.where("idx IS NOT NULL").select("block", "id", "idx", "n"), out.where("term IS NOT NULL").select("block", "term", F.col("at").alias("idx")),
                  blocks, id_type)


def each_block(blocks: Blocks, table: DataFrame | None, task: Callable[[list[pa.RecordBatch]], BlockTask], schema: str, how: str = "inner", words: bool = True) -> DataFrame:
    """Run ``task`` over all blocks against ``table`` (term, c), or only their terms; a block without term rows is passed over.

    ``c`` is an array of double, or what the task makes of it; without ``words`` the task gets no terms, only their numbers.
    """
    none, given = F.lit(None), "c" in blocks.docs.columns
    kind = table.schema["c"].dataType if table is not None else blocks.docs.schema["c"].dataType if given else "array<double>"
    own = F.col("c") if given else none.cast(kind)
    heads = blocks.uses.withColumn("c", none.cast(kind)) if table is None else blocks.uses.join(table.select("term", "c"), "term", how)
    heads = heads.select(
        "block", F.lit(0).alias("kind"), none.cast(blocks.id_type).alias("id"), (F.col("term") if words else none.cast("string")).alias("term"), F.col("idx").alias("at"), "c", none.cast("binary").alias("idx"),
        none.cast("binary").alias("n"))
    docs = blocks.docs.select("block", F.lit(1).alias("kind"), "id", none.cast("string").alias("term"), none.cast("int").alias("at"),
                              own.alias("c"), "idx", "n")
    stream, full = heads.unionByName(docs).repartition(blocks.n, "block").sortWithinPartitions("block", "kind", "id", "at"), blocks.full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("block").to_numpy().astype("i8") << 1 | b.column("kind").to_numpy()
            cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if key[i] >> 1 != now:
                    if block is not None:
                        yield from block.end()
                    now, held, block = key[i] >> 1, [], None
                if not key[i] & 1:
                    held.append(b.slice(i, j - i).select(["term", "at", "c"]))
                elif held or block is not None:
                    if block is None:
                        block, held = task(held), []
                    yield from block.docs(full(b.slice(i, j - i).select(["id", "idx", "n", "c"])))
        if block is not None:
            yield from block.end()

    return stream.mapInArrow(run, schema)


def each_kept_block(blocks: Blocks, table: DataFrame, task: Callable[[list[pa.RecordBatch]], BlockTask], schema: str) -> DataFrame:
    """``each_block`` over blocks that are kept: only the term rows move.  A block is held whole, and so are its results."""
    empty, full = to_arrow_schema(_parse_datatype_string(schema)).empty_table(), blocks.full
    heads = blocks.uses.join(table.select("term", "c"), "term").select(F.col("block").alias("for_block"), "term", F.col("idx").alias("at"), "c")

    def run(docs: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and held.num_rows:
            block = task(held.select(["term", "at", "c"]).to_batches())
            for b in docs.select(["id", "idx", "n"]).to_batches(max_chunksize=10_000):
                out += block.docs(full(b))
            out += block.end()
        return pa.Table.from_batches(out) if out else empty

    return blocks.docs.groupBy("block").cogroup(heads.groupBy("for_block")).applyInArrow(run, schema)


#: Pairs x dims of a block of a grid that is made of blocks: its documents are streamed, only its part of the terms is held.
STREAMED_CELLS = 1 << 31


class Regrid(BlockTask):
    """A block's documents by part of the terms, with the terms' places in their part."""

    def __init__(self, held: list[pa.RecordBatch]):
        at, c = np.concatenate([b.column("at").to_numpy() for b in held]), pa.concat_arrays([b.column("c") for b in held])
        self.at = np.full(int(at.max()) + 2, -1, "i8")     # the last stands for all terms beyond
        self.at[at] = c.field("part").to_numpy().astype("i8") << 32 | c.field("pos").to_numpy()

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idx, n = ([np.frombuffer(x, kind) for x in b.column(c).to_pylist()] for c, kind in (("idx", "<i4"), ("n", "<f8")))
        at, doc = self.at[np.minimum(np.concatenate(idx), len(self.at) - 1)], np.repeat(np.arange(len(idx)), [len(i) for i in idx])
        some = at >= 0
        at, doc, n = at[some], doc[some], np.concatenate(n)[some].astype("i8")
        order = np.lexsort((at, doc))                       # by document, part, place
        at, doc, n = at[order], doc[order], n[order]
        part, pos = at >> 32, at & 0xFFFFFFFF
        first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        step = np.diff(pos, prepend=0)
        step[first] = pos[first]
        cuts = [*first.tolist(), len(at)]
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype("i4")), b.column("id").take(pa.array(doc[first])), pa.array(shortened(step, cuts), pa.binary()),
                                              pa.array(shortened(n, cuts), pa.binary())], names=["part", "id", "idx", "n"])


def regrid(blocks: Blocks, kept: DataFrame, dims: int, cells: int) -> Blocks:
    """``block_grid`` of the documents of packed blocks (short ones), of which the terms ``kept`` count: no row a document and term is made."""
    spark = kept.sparkSession
    size = blocks.docs.agg(F.coalesce(F.sum(F.octet_length("n") - 1), F.lit(0)), F.count(F.lit(1))).first()     # only for the shape
    parts, cols = grid_size(size[0], kept.count(), size[1], max(1, dims), cells, spark.sparkContext.defaultParallelism, STREAMED_CELLS)
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    words = staged(kept.select("term", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")).withColumn("pos", place), "grid-terms")
    table = words.select("term", F.struct("part", "pos").alias("c"))
    docs = staged(each_block(blocks, table, Regrid, f"part int, id {blocks.id_type}, idx binary, n binary", words=False), "grid")
    at = F.col("part") * cols + F.pmod(F.xxhash64("id"), F.lit(cols))
    docs = docs.select(labelled(spark, at, parts * cols).alias("block"), "id", "idx", "n")
    uses = words.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    uses = uses.select(labelled(spark, F.col("part") * cols + F.col("col"), parts * cols).alias("block"), "term", F.col("pos").alias("idx"))
    return Blocks(docs, uses, parts * cols, blocks.id_type, short=True)


def arrays(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))
