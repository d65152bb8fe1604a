"""Toxicity by maximum-scoring segments of token log-odds.

Token weights: log-odds of a token in toxic against clean labelled documents
(a document counts a token once) with an informative Dirichlet prior, the
pooled distribution; ``z`` standard errors are taken off, so tokens without
evidence weigh nothing.  Tokens are hashed into two independent count tables of ``bins``
cells, and a token's counts are the smaller of its two cells, so collisions
matter only when both collide.  A constant drift makes a clean token's mean
weight negative.  All maximal-scoring segments of a document are found in one
linear scan (Ruzzo and Tompa).  A segment score s in n tokens has, by
extreme-value theory, E = K n exp(-lambda s) in clean text; lambda and K are
fitted on the clean training documents' best segments (method of moments of
the Gumbel law).  Segments with E <= ``max_e`` are significant, and a
document's evidence is the sum of their calibrated scores.  A logistic curve,
fitted on a bounded histogram of all training documents' evidence, maps it to
0..1.

Defined results: null, empty or blank texts have evidence 0 and the score of
that evidence; without toxic training labels every score is near 0, without clean
ones near 1; a document with several labels counts with each; ids may be null or repeat (each row is scored by its own
text); an empty table gives no rows; a very long text is scanned whole, in linear time; other columns, whatever their
names, are never inputs.  Memory is bounded by a document and the two tables (2 x ``bins`` cells, which is also the bound
of what is broadcast).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LABEL_BOUND, held_out, labelled_sample, stage_table

_CACHE: dict[bytes, float] = {}
CACHE_MAX = 400_000
_STRIP = b".,;:!?\"'()[]"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation at the ends."""
    return [w.strip(_STRIP) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def cells(word: bytes, bins: int) -> tuple[int, int]:
    return zlib.crc32(word) % bins, bins + zlib.adler32(word, zlib.crc32(word[::-1])) * 2654435761 % (1 << 32) % bins


def maximal_segments(x: np.ndarray | list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), left to right.

    Every segment keeps the number of its left match, the nearest segment before
    it whose sum before is smaller; a search follows these links, and no search
    after it steps on the segments that it passed, so the scan is linear.
    """
    start: list[int] = []
    end: list[int] = []
    low: list[float] = []     # cumulative sum before the segment
    high: list[float] = []    # and after it
    left: list[int] = []      # left match, -1 for none
    total = 0.0
    for i, v in enumerate(x):
        before, total = total, total + v
        if v <= 0:
            continue
        first, base = i, before
        j = len(low) - 1
        while j >= 0 and low[j] >= base:
            j = left[j]
        while j >= 0 and high[j] < total:   # the segments from j on join the new one
            first, base, after = start[j], low[j], left[j]
            del start[j:], end[j:], low[j:], high[j:], left[j:]
            j = after
        start.append(first)
        end.append(i + 1)
        low.append(base)
        high.append(total)
        left.append(j)
    return [(a, b, q - p) for a, b, p, q in zip(start, end, low, high)]


@dataclass
class Model:
    clean: np.ndarray        # token counts of the clean class in both tables
    toxic: np.ndarray
    z: float = 2.0
    drift: float = 0.0

    def __post_init__(self):
        half = len(self.clean) // 2
        self.totals = float(self.clean[:half].sum()), float(self.toxic[:half].sum())

    def weights(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of words, shrunk by ``z`` of their standard errors towards 0, before the drift.

        The Dirichlet prior is the pooled distribution, as many tokens as the toxic class has.
        """
        at = np.array([cells(w, len(self.clean) // 2) for w in words], "i8").reshape(-1, 2)
        c, t = (n[at].min(axis=1).astype("f8") for n in (self.clean, self.toxic))
        nc, nt = self.totals
        pool = nt * (c + t + 0.5) / (nc + nt + 1.0)
        odds = np.log((t + pool) / (2 * nt - t - pool)) - np.log((c + pool) / (nc + nt - c - pool))
        error = np.sqrt(1 / (t + pool) + 1 / (c + pool))
        return np.sign(odds) * np.maximum(np.abs(odds) - self.z * error, 0)


def _labels_of(batch: pa.RecordBatch, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clean, toxic) labels of each row; ``labels``: rows (id, clean, toxic) sorted by id."""
    ids = batch.column(0).fill_null(-1).to_numpy()
    at = np.minimum(np.searchsorted(labels[:, 0], ids), max(len(labels) - 1, 0))
    hit = (labels[at, 0] == ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False) if len(labels) else np.zeros(len(ids), bool)
    return (np.where(hit, labels[at, k], 0) if len(labels) else np.zeros(len(ids), "i8") for k in (1, 2))


def word_counts(docs: DataFrame, labels, id_col: str, text_col: str, bins: int) -> DataFrame:
    """(cell, clean, toxic) over the labelled rows; ``labels`` is a broadcast."""
    schema = pa.schema([("cell", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * bins), "i8")
        where: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            label = list(_labels_of(b, labels.value))
            own = np.flatnonzero(label[0] + label[1])
            for i, text in zip(own.tolist(), b.column(1).take(pa.array(own)).to_pylist()):
                words = set(tokens(text))   # a text counts a token once: one author's habit is no evidence
                if len(where) > CACHE_MAX:
                    where.clear()
                for w in words.difference(where):
                    where[w] = cells(w, bins)
                at = np.array([where[w] for w in words], "i8").ravel()
                for k in (0, 1):
                    if label[k][i]:
                        np.add.at(n[k], at, int(label[k][i]))
        at = np.flatnonzero(n.sum(axis=0))
        for i in range(0, len(at), 65536):
            k = at[i:i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype("i4")), pa.array(n[0, k]), pa.array(n[1, k])], schema=schema)

    return (docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "cell int, clean bigint, toxic bigint")
            .groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def _weights(model: Model, words: list[bytes]) -> np.ndarray:
    if len(_CACHE) > CACHE_MAX:
        _CACHE.clear()
    new = list(set(words).difference(_CACHE))
    if new:
        _CACHE.update(zip(new, model.weights(new).tolist()))
    return np.fromiter(map(_CACHE.__getitem__, words), "f8", len(words)) + model.drift


SCAN_DDL = "doc_id bigint, n_tokens bigint, clean bigint, toxic bigint, segments array<struct<start:bigint,end:bigint,score:double>>"


def scan(docs: DataFrame, model, labels, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens, training labels and all maximal segments (start, end, raw score) of every document."""
    seg = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("clean", pa.int64()), ("toxic", pa.int64()), ("segments", seg)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CACHE.clear()   # the weights belong to this model
        for b in batches:
            n, found = [], []
            for text in b.column(1).to_pylist():
                words = tokens(text)
                x = _weights(model.value, words)
                n.append(len(words))
                found.append([{"start": s, "end": e, "score": float(v)} for s, e, v in maximal_segments(x.tolist())] if len(x) and x.max() > 0 else [])
            clean, toxic = _labels_of(b, labels.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64()),
                                              pa.array(found, seg)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCAN_DDL)


def _logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(1) = 1 / (1 + exp(-(a + b x))) on counts, with a weak ridge on b."""
    a, b = 0.0, 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a + b * x)))
        n = n0 + n1
        g = np.array([(n1 - n * p).sum(), ((n1 - n * p) * x).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-9, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def word_model(docs: DataFrame, labels, *, id_col: str, text_col: str, bins: int, z: float, drift: float) -> Model:
    got = word_counts(docs, labels, id_col, text_col, bins).toArrow()   # at most 2 * bins rows
    clean, toxic = np.zeros(2 * bins, "f4"), np.zeros(2 * bins, "f4")
    at = got.column("cell").to_numpy()
    clean[at], toxic[at] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    return Model(clean, toxic, z, drift)


def _grid(df: DataFrame, value, step: float) -> np.ndarray:
    """Rows (value, clean, toxic) on a bounded grid."""
    cell = F.least(F.greatest(F.round(value / step), F.lit(-2000)), F.lit(20_000)).cast("int")
    rows = df.groupBy(cell.alias("c")).agg(F.sum("clean").alias("n0"), F.sum("toxic").alias("n1")).collect()
    return np.array(sorted((r["c"] * step, r["n0"], r["n1"]) for r in rows), "f8").reshape(-1, 3)


def gumbel(training: DataFrame) -> tuple[float, float]:
    """(lambda, ln K) of clean documents' best segments: s - ln(n)/lambda has mean (ln K + 0.5772)/lambda and sd pi/(lambda sqrt 6)."""
    lam, log_k = 1.0, 0.0
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    for _ in range(3):
        law = _grid(training, best - F.log(F.greatest("n_tokens", F.lit(1))) / lam, 0.05)
        x, n = law[:, 0], law[:, 1]
        if n.sum() == 0:
            break
        mean = (x * n).sum() / n.sum()
        sd = max(np.sqrt(((x - mean) ** 2 * n).sum() / n.sum()), 0.05)
        lam = float(np.pi / (sd * np.sqrt(6)))
        log_k = float(lam * mean - 0.5772156649)
    return lam, log_k


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                   label_col: str = "toxic", holdout: int = 5, bins: int = 1 << 19, z: float = 2.0, drift: float = -0.25, max_e: float = 0.1,
                   label_bound: int = LABEL_BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, evidence, segments (significant ones, calibrated scores).

    Learns only from labelled ids that are not held out, at most about ``label_bound``.
    """
    spark = docs.sparkSession
    learn = labels.where(~held_out(label_id, holdout) & F.col(label_col).isin(0, 1)).select(
        F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    got = labelled_sample(learn, "id", label_bound)
    ids, back = np.unique(got.column("id").to_numpy(), return_inverse=True)
    y = got.column("y").to_numpy()
    known = spark.sparkContext.broadcast(np.stack([ids, *(np.bincount(back[y == k], minlength=len(ids)) for k in (0, 1))], axis=1).astype("i8"))
    model = word_model(docs, known, id_col=id_col, text_col=text_col, bins=bins, z=z, drift=drift)
    shared = spark.sparkContext.broadcast(model)   # bounded by ``bins``
    scanned = stage_table(scan(docs, shared, known, id_col=id_col, text_col=text_col), "toxic-segments")
    training = scanned.where("clean + toxic > 0")
    lam, log_k = gumbel(training)
    floor = F.lit(log_k) + F.log(F.greatest("n_tokens", F.lit(1)))
    good = F.filter(F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (lam * s["score"] - floor).alias("score"))),
                    lambda s: s["score"] >= -np.log(max_e))
    rows = scanned.withColumn("segments", good).withColumn("evidence", F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["score"]))
    law = _grid(rows.where("clean + toxic > 0"), F.col("evidence"), 0.1)
    if len(law) == 0 or law[:, 2].sum() == 0:
        a, b = -40.0, 0.0
    elif law[:, 1].sum() == 0:
        a, b = 40.0, 0.0
    else:
        a, b = _logistic(np.log1p(np.maximum(law[:, 0], 0)), law[:, 1], law[:, 2])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p(F.greatest("evidence", F.lit(0.0))))))
    return (rows.withColumn("held_out", held_out("doc_id", holdout)).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "n_tokens", "evidence", "segments"))
