"""Which n-grams are too rare to count, before any of them is made a string (V4).

The texts are read twice.  First each part of the documents sends, by range of a
hash, the hashes of its n-grams with their numbers; a range adds them up and sends
each part those of its hashes that may be kept.  Then the n-grams of these hashes
alone are built and counted.  A hash that several n-grams share is kept for all of
them, so none is lost, and what is kept is trimmed by exact totals as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.operators.blocks import Blocks, counted_blocks, labelled, lengthened, shortened
from topicscope.staging import discard, staged

#: Bits of a hash that are sent, those beside it for a class, and hashes that are held until they are added up.
BITS, CLASS_BITS, HELD = 34, 30, 1 << 22


class Grams:
    """The n-grams of token lists: their hashes, and their strings where they are wanted."""

    def __init__(self, lo: int, hi: int, sep: str):
        self.lo, self.hi, self.sep, self.hashes = lo, hi, sep, {}

    def _token_hashes(self, words: list[str]) -> np.ndarray:
        if len(self.hashes) > 1 << 19:
            self.hashes = {}
        known = self.hashes
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([known[w] for w in words], "u8")

    def each(self, tokens: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]]:
        """For each n: (first ``BITS`` bits of the hashes, the rows they are of, what makes strings of the places of some)."""
        code = tokens.flatten().dictionary_encode()
        words, at = code.dictionary, code.indices.to_numpy()
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype("i8")
        row = np.repeat(np.arange(len(sizes)), sizes)
        own = self._token_hashes(words.to_pylist())[at]
        for n in range(self.lo, self.hi + 1):
            first = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if n <= len(row) else np.zeros(0, "i8")    # an n-gram lies in one row
            h = np.full(len(first), n, "u8")
            for i in range(n):
                h = (h ^ own[first + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)

            def strings(some: np.ndarray, first=first, n=n) -> pa.Array:
                parts = [words.take(pa.array(at[first[some] + i])) for i in range(n)]
                return pc.binary_join_element_wise(*parts, self.sep) if n > 1 else parts[0]

            yield h >> np.uint64(64 - BITS), row[first], strings


class Sums:
    """Numbers of hashes, held in order."""

    def __init__(self, most: int):
        self.most, self.keys, self.n = most, [], []

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(np.ones(len(keys), "u4"))
        if sum(map(len, self.keys[1:])) > HELD:
            self._merge()

    def _merge(self) -> None:
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        keys, where = np.unique(keys, return_inverse=True)
        self.keys, self.n = [keys], [np.minimum(np.bincount(where, n, len(keys)), self.most).astype("u4")]

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            self._merge()
        return (self.keys[0], self.n[0]) if self.keys else (np.zeros(0, "u8"), np.zeros(0, "u4"))


def _steps(keys: np.ndarray) -> bytes:
    """Sorted numbers below 2^32 as bytes."""
    return shortened(np.diff(keys, prepend=keys.dtype.type(0)), [0, len(keys)])[0]


def often(rows: DataFrame, parts: int, least: int, grams: tuple[int, int, str]) -> DataFrame:
    """(part, at, low): for each part, the hashes (those of range ``at`` by their lower bits) of n-grams whose hash comes more than ``least`` times in all.

    ``rows``: (part, tokens), a part's rows together.  With a column ``class`` (a number), more than ``least`` classes must have the hash.
    """
    by_class = "class" in rows.columns
    bits = BITS - max(2, min(BITS - 1, int(np.ceil(np.log2(max(parts, 2))))))       # lower bits of a range
    names = ["at", "part", "low", "n"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, made = None, None, Grams(*grams)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = sums.get()
            if by_class:
                keys, n = keys >> np.uint64(CLASS_BITS), keys & np.uint64((1 << CLASS_BITS) - 1)
            ranges = keys >> np.uint64(bits)
            first = np.flatnonzero(np.diff(ranges.astype("i8"), prepend=-1)).tolist()
            for a, b in zip(first, [*first[1:], len(keys)]):
                yield pa.RecordBatch.from_arrays([pa.array([int(ranges[a])], pa.int32()), pa.array([now], pa.int32()), pa.array([_steps(keys[a:b] & np.uint64((1 << bits) - 1))], pa.binary()),
                                                  pa.array(shortened(n[a:b], [0, b - a]), pa.binary())], names=names)

        for b in batches:
            part = b.column("part").to_numpy()
            cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(b)]) if len(b) else ():
                if part[i] != now:
                    if sums is not None:
                        yield from out()
                    now, sums = int(part[i]), Sums(least + 1)
                for keys, row, _ in made.each(b.column("tokens").slice(i, j - i)):
                    sums.add(keys << np.uint64(CLASS_BITS) | b.column("class").slice(i, j - i).to_numpy().astype("u8")[row] if by_class else keys)
        if sums is not None:
            yield from out()

    def add_up(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(lengthened(x), dtype="u8") for x in t.column("low").to_pylist()]
        n = np.concatenate([lengthened(x) for x in t.column("n").to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(np.unique(where.astype("u8") << np.uint64(CLASS_BITS) | n.astype("u8")) >> np.uint64(CLASS_BITS)) if by_class else np.bincount(where, n)
        keep, at = (counts > least)[where], 0
        some = []
        for k in keys:
            some.append(np.unique(k[keep[at:at + len(k)]]))
            at += len(k)
        rows = [i for i, k in enumerate(some) if len(k)]
        return pa.table({"part": t.column("part").take(pa.array(rows, pa.int64())), "at": t.column("at").take(pa.array(rows, pa.int64())), "low": pa.array([_steps(some[i]) for i in rows], pa.binary())})

    sent = rows.mapInArrow(send, "at int, part int, low binary, n binary").repartition(max(1, min(parts, 1 << (BITS - bits))), "at")
    return sent.groupBy("at").applyInArrow(add_up, "part int, at int, low binary").withColumn("bits", F.lit(bits))


def sifted_blocks(docs: DataFrame, tokens: Callable[[DataFrame], DataFrame], parts: int, least: int, grams: tuple[int, int, str], pairs: int = 1 << 21,
                  classes: list | None = None) -> Blocks:
    """``blocks.block_terms`` of documents (id, topic, text), without the n-grams that come ``least`` times or fewer in all (a few of them may stay).

    ``tokens`` adds a column ``tokens`` to rows with a ``text``.  Given the ``classes`` (values of topic; null is one more),
    n-grams of ``least`` classes or fewer are left out instead, and only terms by class are kept, no documents.
    """
    spark = docs.sparkSession
    id_type, topic_type = (docs.schema[c].dataType.simpleString() for c in ("id", "topic"))
    docs = docs.withColumn("part", labelled(spark, F.pmod(F.xxhash64("id"), F.lit(parts)), parts))
    number = [] if classes is None else [F.coalesce(F.array_position(F.array(*[F.lit(x) for x in classes]).cast(f"array<{topic_type}>"), F.col("topic")), F.lit(0)).cast("int").alias("class")]
    rows = tokens(docs.select("part", *number, "text").repartition(parts, "part").sortWithinPartitions("part"))
    rows = rows.select("part", *(["class"] if number else []), "tokens")
    kept, none = staged(often(rows, parts, least, grams), "often"), F.lit(None)
    heads = kept.select("part", F.lit(0).alias("kind"), none.cast(id_type).alias("id"), none.cast(topic_type).alias("topic"), none.cast("string").alias("text"), "at", "low", "bits")
    texts = docs.select("part", F.lit(1).alias("kind"), "id", "topic", "text", none.cast("int").alias("at"), none.cast("binary").alias("low"), none.cast("int").alias("bits"))
    stream = heads.unionByName(texts).repartition(parts, "part").sortWithinPartitions("part", "kind", "id", "topic", "at")
    stream = tokens(stream).select("part", "kind", "id", "topic", "tokens", "at", "low", "bits")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches (id, topic, terms) of whole slices of a part."""
        now, held, known, made = None, [], None, Grams(*grams)
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("part").to_numpy().astype("i8") << 1 | b.column("kind").to_numpy()
            cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(b)]):
                if key[i] >> 1 != now:
                    now, held, known = key[i] >> 1, [], None
                x = b.slice(i, j - i)
                if not key[i] & 1:
                    held += [(at << bits) + np.cumsum(lengthened(low), dtype="u8") for at, low, bits in zip(*(x.column(c).to_pylist() for c in ("at", "low", "bits")))]
                    continue
                known = np.concatenate([*held, np.zeros(0, "u8")]) if known is None else known      # in order: by range
                got = []
                for keys, row, strings in made.each(x.column("tokens")):
                    some = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys) if len(known) else np.zeros(0, "i8")
                    got.append((row[some], strings(some)))
                rows, words = np.concatenate([r for r, _ in got]), pa.concat_arrays([w.cast(pa.string()) for _, w in got])
                ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(x))))
                yield pa.RecordBatch.from_arrays([x.column("id"), x.column("topic"), pa.ListArray.from_arrays(pa.array(ends.astype("i4")), words.take(pa.array(np.argsort(rows, kind="stable"))))],
                                                 names=["id", "topic", "terms"])

    out = counted_blocks(stream, terms, id_type, topic_type, pairs, documents=classes is None)
    discard(kept)
    return out
