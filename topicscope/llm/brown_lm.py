"""Language-model scores from Brown class-based bigrams.

1. Vocabulary: exact counts of all training words (one ``end`` per document).
2. Exchange clustering.  Words with a relative frequency of ``share`` or more
   (at most 1 / share words, so a small table) are clustered by exchange sweeps:
   Spark counts each word's left and right neighbours by class over the whole
   corpus, then a sweep moves each word to the class with the highest mutual
   information, keeping the class table current.  All other words, however
   rare, make one exchange step of their own against the settled classes, from
   all their contexts in the corpus.
3. Model: P(w | h) = P(class(w) | class(h)) P(w | class(w)) for known words,
   with discounted emissions and transitions smoothed towards the class
   frequencies; an unknown word is one more type whose probability after each
   class is that of a training word seen once.  All types sum to one.
4. Scores: each document's class sequence is written once and scored against the
   transition table.

Documents are read in blocks (consecutive rows of an input partition, cut when
a block holds ``block_words`` different infrequent words or 4 million
occurrences of them).  A block's rows are its
documents, with words as numbers, and its dictionary; dictionary rows are
grouped by word over the corpus, with their neighbours counted by class, and
return to their block, so that no vocabulary is broadcast or held by one task.

Defined results: null, empty or blank text is its end token alone; a null id
is not held out; repeated rows are scored and counted each; with no training
rows all tokens are unknown and have probability 1; an empty table gives no
rows; a very long text is one row of its block, whole; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stage_table

END = b""          # no word is empty
RARE, UNKNOWN, ONCE = 254, 255, 128   # marks in class sequences; ONCE is added to the class of a word seen once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _batches(columns: list[list], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + size], f.type) for c, f in zip(columns, schema)], schema=schema)


def vocabulary(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word binary, c) over training rows (columns: doc_id, text, held)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not held:
                    seen.update(words_of(text))
                    seen[END] += 1
            if len(seen) > flush:
                yield from _batches([list(seen), list(seen.values())], schema)
                seen.clear()
        yield from _batches([list(seen), list(seen.values())], schema)

    return docs.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_pairs(docs: DataFrame, ids, k: int, flush: int = 500_000) -> DataFrame:
    """(a, b, n): neighbours among frequent words; number ``k`` stands for all others."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, end = ids.value, ids.value[END]
        keys, counts, held_rows = [], [], 0

        def reduced():
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts)).astype("i8")

        for b in batches:
            for text, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held:
                    continue
                seq = [end, *(number.get(w, k) for w in words_of(text)), end]
                x = np.array(seq, "i8")
                keys.append(x[:-1] * (k + 1) + x[1:])
                counts.append(np.ones(len(x) - 1))
                held_rows += len(x)
                if held_rows > flush:
                    key, n = reduced()
                    keys, counts, held_rows = [key], [n], 0
                    if len(key) > 2 * flush:
                        yield from _batches([(key // (k + 1)).astype("i4"), (key % (k + 1)).astype("i4"), n], schema)
                        keys, counts = [], []
        if keys:
            key, n = reduced()
            yield from _batches([(key // (k + 1)).astype("i4"), (key % (k + 1)).astype("i4"), n], schema)

    return docs.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def context_counts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): counts of each frequent word's neighbours by class, summed in Spark.

    ``classes`` has one entry a frequent word and one for all others.  The
    result has 2 * words * (classes + 1) numbers, whatever the corpus.
    """
    spark = pairs.sparkSession
    of = spark.createDataFrame(pa.table({"w": pa.array(np.arange(len(classes), dtype="i4")), "c": pa.array(classes.astype("i4"))}))
    of = F.broadcast(of)   # at most 1 / share rows
    right = pairs.join(of.withColumnRenamed("w", "b"), "b").groupBy(F.col("a").alias("w"), "c").agg(F.sum("n").alias("n")).withColumn("side", F.lit(1))
    left = pairs.join(of.withColumnRenamed("w", "a"), "a").groupBy(F.col("b").alias("w"), "c").agg(F.sum("n").alias("n")).withColumn("side", F.lit(0))
    got = left.unionByName(right).toArrow()
    out = np.zeros((2, len(classes), n_classes + 1))
    out[got.column("side").to_numpy(), got.column("w").to_numpy(), got.column("c").to_numpy()] = got.column("n").to_numpy()
    return out[0], out[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def class_table(right: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Class bigram counts, the class ``n_classes`` being all infrequent words."""
    m = np.zeros((n_classes + 1, n_classes + 1))
    np.add.at(m, classes, right)
    return m


def exchange_sweep(left: np.ndarray, right: np.ndarray, classes: np.ndarray, n_classes: int) -> int:
    """Move each frequent word to its best class, one after another; returns the moves.

    The gain of a class is the change of sum N(c,d) ln N(c,d) - 2 sum N(c) ln N(c).
    Class 0 is the end token's alone.
    """
    m = class_table(right, classes, n_classes)
    total = m.sum(axis=1)
    moves = 0
    order = np.argsort(-right[:-1].sum(axis=1), kind="stable")
    for w in order.tolist():
        c = classes[w]
        n = right[w].sum()
        if c == 0 or n == 0:
            continue
        m[c] -= right[w]
        m[:, c] -= left[w]
        total[c] -= n
        np.maximum(m, 0, out=m)
        rows, cols = m[1:n_classes], m[:, 1:n_classes].T
        gain = ((_xlogx(rows + right[w]) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + left[w]) - _xlogx(cols)).sum(axis=1)
                - 2 * (_xlogx(total[1:n_classes] + n) - _xlogx(total[1:n_classes])))
        best = 1 + int(np.argmax(gain))
        moves += best != c
        classes[w] = best
        m[best] += right[w]
        m[:, best] += left[w]
        total[best] += n
    return moves


@dataclass
class Frequent:
    number: dict[bytes, int]     # word -> place; END is 0
    classes: np.ndarray          # class by place
    counts: np.ndarray


BLOCK_DDL = "block bigint, doc_id bigint, held boolean, classes binary, places binary, rare binary, word binary, number int, contexts binary"
BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("classes", pa.binary()), ("places", pa.binary()),
                   ("rare", pa.binary()), ("word", pa.binary()), ("number", pa.int32()), ("contexts", pa.binary())])


class Contexts:
    """Neighbour classes of a block's infrequent words, as counts: a sparse (word number, slot) table.

    A slot is a left class, or ``width`` + a right class.  Occurrences are
    merged into the table every ``flush`` of them, so memory follows the table.
    """

    def __init__(self, width: int, flush: int = 500_000):
        self.width, self.flush = width, flush
        self.keys, self.counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.occurrences = 0

    def add(self, numbers: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        at = numbers * (2 * self.width)
        self.waiting += [at + left, at + self.width + right]
        self.n_waiting += 2 * len(numbers)
        self.occurrences += len(numbers)
        if self.n_waiting > self.flush:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            keys, back = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            self.counts = np.bincount(back, np.concatenate([self.counts, n]), minlength=len(keys)).astype("i8")
            self.keys, self.waiting, self.n_waiting = keys, [], 0

    def rows(self, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes by word, end of each word's bytes): a left and a right class for a single occurrence, else entries slot << 24 | count."""
        self.merge()
        number, slot = np.divmod(self.keys, 2 * self.width)
        counts = np.minimum(self.counts, (1 << 24) - 1)
        one = (np.bincount(number, counts, minlength=n_words) == 2)[number]
        size = np.where(one, 1, 4)
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), "u1")
        out[at[one]] = slot[one] % self.width
        out[at[~one][:, None] + np.arange(4)] = (slot[~one] << 24 | counts[~one]).astype("<u4").view("u1").reshape(-1, 4)
        return out, np.cumsum(np.bincount(number, size, minlength=n_words)).astype("i8")


def read_contexts(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the entries of ``Contexts.rows``; row i is ``raw[ends[i]:ends[i + 1]]``, ends from 0."""
    size = np.diff(ends)
    one = np.flatnonzero(size == 2)
    many = raw[np.repeat(size != 2, size)].view("<u4")
    row = np.concatenate([one, one, np.repeat(np.arange(len(size)), np.where(size == 2, 0, size // 4))])
    slot = np.concatenate([raw[ends[one]], width + raw[ends[one] + 1].astype("i8"), many >> 24]).astype("i8")
    return row, slot, np.concatenate([np.ones(2 * len(one), "i8"), (many & 0xFFFFFF).astype("i8")])


def blocks(docs: DataFrame, shared, n_classes: int, block_words: int, block_tokens: int = 4_000_000, slice_rows: int = 512) -> DataFrame:
    """Document rows (classes, places of frequent words, numbers of others) and dictionary rows of all blocks.

    ``contexts`` holds the counts of the neighbours' classes of an infrequent
    word's training occurrences in the block (``Contexts``).  A block ends
    beyond ``block_words`` different words or ``block_tokens`` (under 2^24) training
    occurrences of them, after the slice of ``slice_rows`` documents that goes beyond; one
    text of more occurrences is merged in parts and its counts stop at 2^24 - 1 a slot.
    """
    width = n_classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Frequent = shared.value
        get, classes = model.number.get, model.classes.astype("u1")
        part, made, local, seen = TaskContext.get().partitionId(), 0, {}, Contexts(width)

        def dictionary(block: int) -> Iterator[pa.RecordBatch]:
            entries, ends = seen.rows(len(local))
            word = list(local)
            for i in range(0, len(word), 50_000):
                j = min(i + 50_000, len(word))
                n, first = j - i, int(ends[i - 1]) if i else 0
                offsets = pa.array((np.concatenate([[first], ends[i:j]]) - first).astype("i4"))
                contexts = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(entries[first:int(ends[j - 1])].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
                                                  pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(word[i:j], pa.binary()),
                                                  pa.array(np.arange(i, j, dtype="i4")), contexts], schema=BLOCK)

        for b in (whole.slice(at, slice_rows) for whole in batches for at in range(0, whole.num_rows, slice_rows)):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text, held in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                place = np.fromiter((get(w, -1) for w in words), "i8", len(words))
                other = np.flatnonzero(place < 0)
                kind = np.where(place < 0, RARE, classes[place]).astype("u1")
                numbers = np.fromiter((local.setdefault(words[i], len(local)) for i in other.tolist()), "i8", len(other))
                if not held and len(other):
                    around = np.concatenate([[0], np.minimum(kind, n_classes), [0]]).astype("i8")   # all infrequent words are one class
                    seen.add(numbers, around[other], around[other + 2])
                for c, v in zip(rows, ((part << 24) + made, doc_id, bool(held), kind.tobytes(), place[place >= 0].astype("<u2").tobytes(),
                                       numbers.astype("<u4").tobytes())):
                    c.append(v)
            n = len(rows[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(rows, BLOCK)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()),
                                              pa.nulls(n, pa.binary())], schema=BLOCK)
            if len(local) > block_words or seen.occurrences > block_tokens:
                yield from dictionary((part << 24) + made)
                made, local, seen = made + 1, {}, Contexts(width)
        if local:
            yield from dictionary((part << 24) + made)

    return docs.mapInArrow(run, BLOCK_DDL)


WORD_DDL = "block bigint, number int, class int, c bigint, first boolean"
WORD = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("class", pa.int32()), ("c", pa.int64()), ("first", pa.bool_())])


def classify(dictionary: DataFrame, table: np.ndarray, n_classes: int) -> DataFrame:
    """(block, number, class, c, first) of every infrequent word that occurs in training.

    A word's rows (one a block, with counts) meet in one sorted stream; their
    counts are summed and the word takes the class with the highest likelihood
    of its contexts; ``c`` is its count in the corpus.  ``first`` marks one row a word.  A task holds
    the sums of the words in hand and two numbers a row of them.
    """
    width = n_classes + 1
    total = table.sum(axis=1)
    into = np.log((table + 0.5) / (total[None, :] + 0.5 * width))[:, 1:n_classes]        # left class -> class
    out = np.log((table.T + 0.5) / (total[None, :] + 0.5 * width))[:, 1:n_classes]       # right class <- class
    likelihood = np.concatenate([into, out])                                             # slot -> class
    rows = dictionary.select("word", "block", "number", "contexts").repartition("word").sortWithinPartitions("word", "block")

    def solve(words: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch | None:
        """``words``: (block, number) of each word's rows."""
        best, total = 1 + np.argmax(sums @ likelihood, axis=1), sums[:, :width].sum(axis=1).astype("i8")
        at, w = np.concatenate(words), np.repeat(np.arange(len(words)), [len(x) for x in words])
        known = np.flatnonzero(total[w] > 0)
        if not len(known):
            return None
        first = np.concatenate([[True], np.diff(w) != 0])
        return pa.RecordBatch.from_arrays([pa.array(at[known, 0]), pa.array(at[known, 1].astype("i4")), pa.array(best[w[known]].astype("i4")),
                                           pa.array(total[w[known]]), pa.array(first[known])], schema=WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, done, sums = None, [], []       # the word in hand is the last of both lists
        for b in batches:
            if not b.num_rows:
                continue
            ctx = b.column(3)
            ends = np.frombuffer(ctx.buffers()[1], "i4")[ctx.offset:ctx.offset + len(ctx) + 1].astype("i8")
            raw = np.frombuffer(ctx.buffers()[2], "u1")[ends[0]:ends[-1]] if ctx.buffers()[2] is not None else np.zeros(0, "u1")
            row, slot, n = read_contexts(raw, ends - ends[0], width)
            at = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy().astype("i8")], axis=1)
            names = b.column(0).dictionary_encode()                       # words come in runs
            run_of = names.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(run_of)) + 1, [len(ctx)]])
            here = np.zeros((len(starts) - 1, 2 * width))
            np.add.at(here, (np.searchsorted(starts, row, "right") - 1, slot), n.astype("f8"))
            for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                name = names.dictionary[int(run_of[i])].as_py()
                if name == word:
                    done[-1] = np.concatenate([done[-1], at[i:j]])
                    sums[-1] = sums[-1] + here[k]
                else:
                    word = name
                    done.append(at[i:j])
                    sums.append(here[k])
            if len(done) > 4096:
                if (r := solve(done[:-1], np.stack(sums[:-1]))) is not None:
                    yield r
                done, sums = done[-1:], sums[-1:]
        if done and (r := solve(done, np.stack(sums))) is not None:
            yield r

    return rows.mapInArrow(run, WORD_DDL)


@dataclass
class Emission:
    n: int                    # training tokens
    v: int                    # training types
    discount: float
    log_norm: np.ndarray      # log10 of each class's discounted total

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def word(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.log10(c - self.discount) - self.log_norm[k]


SEQ_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, seq binary"
SEQ = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
                 ("emission", pa.float64()), ("seq", pa.binary())])


def sequences(rows: DataFrame, words: DataFrame, shared, emission: Emission) -> DataFrame:
    """Each document's class sequence (end included), base score and emission sum.

    A block's dictionary comes first in the sorted stream, its documents follow.
    """
    none = F.lit(None)
    d = rows.where(F.col("word").isNull()).select("block", none.cast("int").alias("number"), none.cast("int").alias("class"), none.cast("bigint").alias("c"),
                                                  "doc_id", "held", "classes", "places", "rare")
    w = words.select("block", "number", "class", "c", none.cast("bigint").alias("doc_id"), none.cast("boolean").alias("held"),
                     *(none.cast("binary").alias(n) for n in ("classes", "places", "rare")))
    stream = w.unionByName(d).repartition("block").sortWithinPartitions("block", F.col("held").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq: Frequent = shared.value
        now, parts, klass, count = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(0).to_numpy()
            is_doc = b.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_doc.astype("i1")) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if block[i] != now:
                    now, parts, klass = block[i], [], None
                piece = b.slice(i, j - i)
                if not is_doc[i]:
                    parts.append(tuple(piece.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
                    continue
                if klass is None:
                    top = max((int(p[0].max()) for p in parts), default=-1) + 1
                    klass, count = np.full(top, UNKNOWN, "u1"), np.zeros(top, "i8")
                    for number, c, n in parts:
                        klass[number], count[number] = c, n
                    parts = []
                out: list[list] = [[] for _ in SEQ]
                for doc_id, held, classes, places, rare in zip(*(piece.column(k).to_pylist() for k in range(4, 9))):
                    seq = np.frombuffer(classes, "u1").copy()
                    r = np.frombuffer(rare, "<u4")
                    known_r = r < len(klass)
                    rc, rn = np.full(len(r), UNKNOWN, "u1"), np.zeros(len(r), "i8")
                    rc[known_r], rn[known_r] = klass[r[known_r]], count[r[known_r]]
                    place = np.frombuffer(places, "<u2")
                    at = seq == RARE
                    pc = seq[~at]
                    n = np.concatenate([freq.counts[place], rn, freq.counts[:1]])       # frequent, others, end
                    k = np.concatenate([pc, rc, [0]])
                    seen = n > 0
                    mark = rc.copy()
                    if not held:
                        mark[rn == 1] += ONCE
                    seq[at] = mark
                    values = (doc_id, held, len(n), int(seen.sum()), float(emission.base(n).sum()),
                              float(emission.word(n[seen], k[seen]).sum()), seq.tobytes() + b"\0")
                    for c, v in zip(out, values):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SEQ)], schema=SEQ)

    return stream.mapInArrow(run, SEQ_DDL)


def transition_counts(seqs: DataFrame, n_classes: int) -> np.ndarray:
    """Counts (state, next) over training documents; states and nexts: classes, then ``n_classes`` for words seen once.

    A word seen once counts under its class and, besides, as the unknown state;
    a once-seen next word counts in the last column as well.
    """
    width = n_classes + 1
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(width * width, "i8")
        for b in batches:
            for raw in b.column(0).to_pylist():
                x = np.concatenate([[0], np.frombuffer(raw, "u1")]).astype("i8")
                once, c = x >= ONCE, x % ONCE
                a, z = c[:-1], c[1:]
                m += np.bincount(a * width + z, minlength=width * width)
                m += np.bincount(a[once[1:]] * width + n_classes, minlength=width * width)
                m += np.bincount(n_classes * width + z[once[:-1]], minlength=width * width)
                m[n_classes * width + n_classes] += int((once[:-1] & once[1:]).sum())
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(m[at])], schema=schema)

    got = seqs.where(~F.col("held_out")).select("seq").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(width * width)
    m[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return m.reshape(width, width)


def log_transitions(m: np.ndarray, n_classes: int, unseen: float = 10.0, towards: float = 5.0) -> np.ndarray:
    """log10 P(next | state): next class (known word) or unknown, rows sum to one over both."""
    classes = m[:n_classes, :n_classes]
    n = max(classes.sum(), 1.0)
    prior = classes.sum(axis=0) / n
    rate = max(m[:n_classes, n_classes].sum(), 0.5) / n
    state = np.concatenate([classes, m[n_classes:, :n_classes]])
    total = state.sum(axis=1, keepdims=True)
    unknown = (m[:, n_classes:] + unseen * rate) / (total + unseen)
    unknown = np.minimum(unknown, 0.999)
    known = (1 - unknown) * (state + towards * prior) / (total + towards)
    with np.errstate(divide="ignore"):
        return np.log10(np.concatenate([known, unknown], axis=1))


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holdout: int = 10, n_classes: int = 48, share: float = 1 / 8192,
                sweeps: int = 5, block_words: int = 300_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held", held_out("doc_id", holdout))
    vocab = stage_table(vocabulary(d), "lm-vocabulary")
    n, v, once, twice = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    often = vocab.where((F.col("c") >= F.lit(n * share)) & (F.col("c") > 1) | (F.col("word") == F.lit(END))).toArrow()   # at most 1 / share words
    order = sorted(zip(often.column("c").to_pylist(), often.column("word").to_pylist()), key=lambda r: (r[1] != END, -r[0], r[1]))
    if n == 0:
        order = [(0, END)]
    k = len(order)
    counts = np.array([c for c, _ in order], "i8")
    classes = np.concatenate([[0], 1 + np.arange(k - 1) % (n_classes - 1), [n_classes]]).astype("i8")   # the last: infrequent words
    freq = Frequent({w: i for i, (_, w) in enumerate(order)}, classes[:k], counts)
    ids = spark.sparkContext.broadcast(freq.number)
    pairs = stage_table(frequent_pairs(d, ids, k), "lm-pairs")
    for _ in range(sweeps):
        left, right = context_counts(pairs, classes, n_classes)
        if exchange_sweep(left, right, classes, n_classes) == 0:
            break
    left, right = context_counts(pairs, classes, n_classes)
    table = class_table(right, classes, n_classes)
    freq.classes = classes[:k]
    shared = spark.sparkContext.broadcast(freq)

    rows = stage_table(blocks(d, shared, n_classes, block_words), "lm-blocks")
    words = stage_table(classify(rows.where(F.col("word").isNotNull()), table, n_classes), "lm-words")
    sums = {r["class"]: (r["n"], r["v"]) for r in words.where("first").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    discount = min(0.9, once / (once + 2 * twice)) if once else 0.0
    mass = np.array([max(counts[freq.classes == c].sum() + sums.get(c, (0, 0))[0]
                         - discount * (int((freq.classes == c).sum()) + sums.get(c, (0, 0))[1]), 1e-9) for c in range(n_classes)])
    emission = Emission(n, v, discount, np.log10(mass))
    seqs = stage_table(sequences(rows, words, shared, emission), "lm-sequences")
    logs = log_transitions(transition_counts(seqs, n_classes), n_classes)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("emission", pa.float64()), ("t", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for raw in b.column(6).to_pylist():
                x = np.concatenate([[0], np.frombuffer(raw, "u1")]).astype("i8")
                x = np.where(x == UNKNOWN, n_classes, x % ONCE)
                got.append(float(logs[x[:-1], x[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(got, pa.float64())], schema=schema)

    out = seqs.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, t double")
    score = F.col("emission") + F.col("t") if n else F.lit(0.0)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", score.alias("score"))
