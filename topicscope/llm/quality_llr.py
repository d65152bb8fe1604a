"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

A text's units are runs of letters and digits and runs of other symbols (white
space separates); its n-grams of one and two units are hashed into ``bins``.
Two multinomials over the bins are counted over whole tables: the trusted
target (documents labelled good) and the raw corpus (all documents).  A bin's
log ratio is shrunk by pseudo-counts: log((t + k) / (e + k)), e the count that
the target would have at the raw rate.  A document's score is the mean over
its n-grams; it is kept if the score reaches a threshold.  The threshold is
fixed by the labelled documents (a histogram of their scores): the largest
value that still keeps ``keep_share`` of the trusted ones, but no more than
``margin`` below which a document must look worse than the raw corpus.

The base rules (length, repeated three-word windows) come first.

Defined results: null or empty text has no words, fails the base rules and has
score 0; without trusted documents all ratios are 0 and only the base rules
decide; a repeated trusted id counts once; ids may be null or repeat (each row is judged by its own text); other
columns pass through (names that start with ``__q_`` are reserved).  Memory is
bounded by a document and the bins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stage_table

_UNIT = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\x09-\x0d A-Za-z0-9_\x80-\xff]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE: dict[bytes, int] = {}
CACHE_MAX = 400_000
#: N-grams that are held until they are counted.
HELD = 1 << 18
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ngram_bins(text: str | None, bins: int) -> np.ndarray:
    """Bins of the one- and two-unit n-grams, repeats included (``bins`` a power of two)."""
    units = _UNIT.findall((text or "").encode("utf-8", "surrogatepass"))
    if not units:
        return np.zeros(0, "i8")
    if len(_CACHE) > CACHE_MAX:
        _CACHE.clear()
    try:
        h = np.fromiter(map(_CACHE.__getitem__, units), "u8", len(units))
    except KeyError:
        for u in set(units).difference(_CACHE):
            _CACHE[u] = zlib.crc32(u) * 0x9E3779B1 & 0xFFFFFFFF
        h = np.fromiter(map(_CACHE.__getitem__, units), "u8", len(units))
    pairs = (h[:-1] * np.uint64(0x85EBCA6B) + h[1:] * np.uint64(0xC2B2AE35) + np.uint64(0x27D4EB2F))
    both = np.concatenate([h, (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)])
    return (both & np.uint64(bins - 1)).astype("i8")


def add_counts(counts: np.ndarray, texts: pa.Array) -> None:
    """Add the n-grams of all texts to ``counts``; the n-grams of a few hundred thousand at a time (or of one text) are held."""
    held, size = [], 0
    for text in in_slices(texts):
        held.append(ngram_bins(text, len(counts)))
        size += len(held[-1])
        if size > HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    if not words:
        return 0, 0, 0, 0, 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORDS.search(line):
            seen.add(line)
    n, repeat = len(words), 0
    if n >= 4:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n)
        k = len(number)
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]   # pairs renumbered, so no overflow
        tri = pair[:-1] * k + ids[2:]
        _, back, count = np.unique(tri, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        mark = np.zeros(n, bool)
        for j in range(3):
            mark[j:n - 2 + j] |= twice
        repeat = int(mark.sum())
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeat


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Bits of the bitmap of trusted ids (broadcast as at most MARKS / 64 rows).
MARKS = 1 << 24


def _mark(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(MARKS))


def count_bins(docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, bins: int) -> DataFrame:
    """(bin, raw, target): n-gram counts of all documents and of those whose id is in ``trusted`` (one column, ``id``, each once)."""
    schema = pa.schema([("bin", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(bins, "i8"), np.zeros(bins, "i8")
        for b in batches:
            good = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for counts, which in ((target, good), (raw, ~good)):
                if which.any():
                    add_counts(counts, b.column(1).filter(pa.array(which)))
        raw += target
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 65536):
            k = at[i:i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype("i4")), pa.array(raw[k]), pa.array(target[k])], schema=schema)

    # Texts move only if their id may be trusted: a bitmap of hashed ids lets the others (and rows without an id) go
    # round the exact join, which is a shuffle at any size, so that its cost does not jump where a broadcast ends.
    rows = docs.select(F.col(id_col).cast("long").alias("__q_id"), F.col(text_col).alias("__q_text"))
    marks = (trusted.select(_mark("id").alias("at")).groupBy(F.shiftright("at", 6).alias("__q_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("__q_bits")))
    rows = (rows.withColumn("__q_at", _mark("__q_id")).withColumn("__q_word", F.shiftright("__q_at", 6)).join(F.broadcast(marks), "__q_word", "left")
            .withColumn("__q_maybe", F.expr("__q_id IS NOT NULL AND coalesce(shiftright(__q_bits, CAST(__q_at & 63 AS INT)) & 1L, 0L) = 1L")))
    flagged = (rows.where("__q_maybe").select("__q_id", "__q_text").join(trusted.select(F.col("id").alias("__q_id"), F.lit(True).alias("__q_good")).hint("merge"), "__q_id", "left")
               .select(F.coalesce("__q_good", F.lit(False)).alias("good"), "__q_text"))
    flagged = flagged.unionByName(rows.where("NOT __q_maybe").select(F.lit(False).alias("good"), "__q_text"))
    return flagged.mapInArrow(run, "bin int, raw bigint, target bigint").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bins: int, pseudo: float) -> np.ndarray:
    """Shrunk log ratio of each bin (``bins`` floats on the driver, bounded by the parameter)."""
    got = counts.toArrow()
    at = got.column("bin").to_numpy()
    raw, target = got.column("raw").to_numpy().astype("f8"), got.column("target").to_numpy().astype("f8")
    out = np.zeros(bins, "f4")
    if target.sum() > 0:
        out[at] = np.log((target + pseudo) / (raw * (target.sum() / raw.sum()) + pseudo))
    return out


MADE = [f"__q_{n}" for n in (*BASE, "score")]


def score_documents(docs: DataFrame, ratios: np.ndarray, *, text_col: str) -> DataFrame:
    """All rows and columns, with the base counts and the mean log ratio (``__q_...``) added."""
    bins = len(ratios)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    types = [pa.int64()] * len(BASE) + [pa.float64()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(
        f", {n} {'double' if n == '__q_score' else 'bigint'}" for n in MADE)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = shared.value
        for b in batches:
            rows = []
            for text in in_slices(b.column(at)):
                got = ngram_bins(text, bins)
                rows.append((*base_counts(text), float(llr[got].mean(dtype="f8")) if len(got) else 0.0))
            cols = list(zip(*rows)) if rows else [[]] * len(MADE)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names, *MADE])

    return docs.mapInArrow(run, schema)


def threshold(scores: DataFrame, trusted: DataFrame, *, id_col: str, trusted_id: str, keep_share: float, margin: float, step: float = 0.01) -> float:
    """Largest grid value that keeps ``keep_share`` of the trusted documents, at most ``margin``."""
    t = trusted.select(F.col(trusted_id).alias("__t")).where("__t is not null").distinct()
    fine = ~base_failed(F.col("__q_n_words"), F.col("__q_n_repeat_words"))
    hist = (scores.where(fine).select(id_col, "__q_score").join(t, F.col(id_col) == F.col("__t"), "left_semi")
            .groupBy(F.floor(F.col("__q_score") / step).cast("int").alias("b")).agg(F.count("*").alias("n")))
    rows = sorted((r["b"], r["n"]) for r in hist.collect())   # scores span a few dozen units: a bounded grid
    allowed, below, cut = (1 - keep_share) * sum(n for _, n in rows), 0, margin
    for b, n in rows:
        if below + n > allowed:
            cut = min(margin, b * step)
            break
        below += n
    return cut


def judged(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trusted_id: str = "doc_id", carry: list[str] | None = None,
           bins: int = 1 << 17, pseudo: float = 10.0, keep_share: float = 0.999, margin: float = -0.1) -> DataFrame:
    """The rows (columns ``carry``) with ``__q_`` counts and score, ``__q_base_failed`` and ``__q_kept``, from a written table.

    The target multinomial, raw counts, scores and the threshold cover all
    documents that are named.
    """
    ids = trusted.select(F.col(trusted_id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    counts = count_bins(docs, ids, id_col=id_col, text_col=text_col, bins=bins)
    rows = score_documents(docs.select(*(carry or docs.columns)) if carry is None or text_col in carry else docs.select(*carry, text_col),
                           log_ratios(counts, bins, pseudo), text_col=text_col)
    rows = stage_table(rows.select(*(carry or docs.columns), *MADE), "quality-scores")
    cut = threshold(rows, trusted, id_col=id_col, trusted_id=trusted_id, keep_share=keep_share, margin=margin)
    failed = base_failed(F.col("__q_n_words"), F.col("__q_n_repeat_words"))
    return rows.withColumn("__q_base_failed", failed).withColumn("__q_kept", ~failed & (F.col("__q_score") >= cut))


def judge_quality(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """doc_id, base counts, score, base_failed, kept for every document; ``trusted``: ids of the target."""
    rows = judged(docs, trusted, id_col=id_col, carry=[id_col], **kw)
    return rows.select(F.col(id_col).alias("doc_id"), *(F.col(n).alias(n[4:]) for n in (*MADE, "__q_base_failed", "__q_kept")))


def keep_good(docs: DataFrame, trusted: DataFrame, **kw) -> DataFrame:
    """The rows that are kept, all columns."""
    return judged(docs, trusted, **kw).where("__q_kept").select(*docs.columns)
