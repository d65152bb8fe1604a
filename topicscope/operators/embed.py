"""Embedding-topic pipeline on spark.ml.

Re-aimed from a single-machine stack: document vectors come from an input
array column; a word's vector is the mean of the vectors of the documents that
hold it, and a document without a vector takes the mean of its words' (weighted
by their counts).  UMAP becomes L2 normalisation + PCA, and density clustering
becomes cosine KMeans with an outlier rule (distance above the cluster's 95th
percentile, or a cluster smaller than ``min_size``, gives topic -1).  Topics are
renumbered by size, largest = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicscope.operators.blocks import Blocks, BlockTask, arrays, block_grid, each_block

#: Numbers (terms x dims) that a block holds at most (about).
BLOCK_CELLS = 1 << 23
#: Rows with an array that a task works on, or gives out, at once.
SLICE = 2048


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def vectors_from_array(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), array_to_vector(F.col(array_col).cast("array<double>")).alias("features"))


def dimensions(vectors: DataFrame, col: str) -> int:
    return vectors.agg(F.coalesce(F.max(F.size(col)), F.lit(0))).first()[0]


def mean_by(rows: DataFrame, key: str, col: str, dims: int) -> DataFrame:
    """(key, col): element-wise mean of arrays, summed in each task before the shuffle; nothing is exploded.

    Beyond the end of a shorter array, and where an element is null, it counts as 0.
    """
    sums = [F.sum(F.coalesce(F.get(col, F.lit(i)).cast("double"), F.lit(0.0))) for i in range(dims)]
    out = rows.where(F.col(col).isNotNull()).groupBy(key).agg(F.array(*sums).alias("_sums"), F.count(F.lit(1)).alias("_n"))
    return out.select(key, F.transform("_sums", lambda x: x / F.col("_n")).alias(col))


def _matrix(col: pa.ListArray, dims: int) -> np.ndarray:
    """The arrays as rows; beyond the end of a shorter one, and where an element is null, is 0."""
    out = np.zeros((len(col), dims))
    held = np.arange(dims) < col.value_lengths().to_numpy()[:, None]
    out[held] = pc.fill_null(col.flatten(), 0.0).to_numpy()
    return out


class VectorSums(BlockTask):
    """Sums of the vectors of the documents that hold a term, and their number."""

    def __init__(self, held: list[pa.RecordBatch], dims: int):
        self.terms = pa.concat_arrays([b.column("term") for b in held])
        self.at = np.concatenate([b.column("at").to_numpy() for b in held])
        self.sums, self.n = np.zeros((dims, int(self.at.max()) + 1)), np.zeros(int(self.at.max()) + 1, "i8")

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(b), SLICE):
            part = b.slice(i, SLICE)
            idx = [np.frombuffer(x, "<i4") for x in part.column("idx").to_pylist()]
            at, row = np.concatenate(idx), np.repeat(np.arange(len(idx)), [len(x) for x in idx])
            self.n += np.bincount(at, minlength=len(self.n))
            for total, x in zip(self.sums, _matrix(part.column("c"), len(self.sums)).T):
                total += np.bincount(at, x[row], len(total))
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.n[self.at])
        for i in range(0, len(some), SLICE):
            at = some[i:i + SLICE]
            yield pa.RecordBatch.from_arrays([self.terms.take(pa.array(at)), arrays(self.sums[:, self.at[at]].T), pa.array(self.n[self.at[at]])], names=["term", "sums", "n"])


def _mean_of_sums(rows: DataFrame, key: str, dims: int, n: str) -> DataFrame:
    """(key, vector) from rows (key, sums, n): the sums' sum over the sum of n."""
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).cast("array<double>")
    return rows.groupBy(key).agg(sums.alias("_sums"), F.sum(n).alias("_n")).select(key, F.transform("_sums", lambda x: x / F.col("_n")).alias("vector"))


def word_vectors(dtm: DataFrame, vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "vector", block_cells: int = BLOCK_CELLS,
                 blocks: Blocks | None = None) -> DataFrame:
    """(term, vector): mean vector of the documents that hold the term; terms of no document with a vector have no row.

    A document's vector moves once a part of the terms and a term's sums once a
    part of the documents (``block_grid``), neither once a pair.  Beyond the end of
    a shorter vector, and where an element is null, it counts as 0.
    """
    dims = dimensions(vectors, vec_col)
    blocks = blocks or block_grid(dtm, dims, block_cells, id_col)
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"     # as wide as it was given
    given = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("c"))
    own = Blocks(blocks.docs.join(given, "id"), blocks.uses, blocks.n, blocks.id_type, short=blocks.short)
    rows = each_block(own, None, lambda held: VectorSums(held, dims), "term string, sums array<double>, n bigint")
    return _mean_of_sums(rows, "term", dims, "n")


class SumOfWords(BlockTask):
    """Count-weighted sums of the vectors of a document's known words, and the sum of their counts."""

    def __init__(self, held: list[pa.RecordBatch], dims: int):
        at = np.concatenate([b.column("at").to_numpy() for b in held])
        self.vectors, self.known = np.zeros((int(at.max()) + 1, dims)), np.zeros(int(at.max()) + 1, bool)
        self.vectors[at] = np.concatenate([b.column("c").flatten().to_numpy().reshape(-1, dims) for b in held])
        self.known[at] = True

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, out, size = [], [], []
        for r, (idx, n) in enumerate(zip(b.column("idx").to_pylist(), b.column("n").to_pylist())):
            idx, n = np.frombuffer(idx, "<i4"), np.frombuffer(n, "<f8")
            ok = idx < len(self.known)
            ok[ok] = self.known[idx[ok]]
            if ok.any():
                row.append(r)
                out.append(n[ok] @ self.vectors[idx[ok]])
                size.append(n[ok].sum())
        if row:
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), arrays(np.stack(out)), pa.array(size)], names=["id", "sums", "n"])


def document_vectors(dtm: DataFrame, words: DataFrame, id_col: str = "doc_id", block_cells: int = BLOCK_CELLS, blocks: Blocks | None = None) -> DataFrame:
    """(id, vector): count-weighted mean of a document's word vectors (term, vector); none for a document without a known word."""
    dims = dimensions(words, "vector")
    blocks = blocks or block_grid(dtm, dims, block_cells, id_col)
    rows = each_block(blocks, words.withColumnRenamed("vector", "c"), lambda held: SumOfWords(held, dims), f"id {blocks.id_type}, sums array<double>, n double")
    return _mean_of_sums(rows, "id", dims, "n").withColumnRenamed("id", id_col)


def reduce_dims(vectors: DataFrame, k: int = 5) -> DataFrame:
    """L2-normalise (cosine geometry), then project on the first k principal axes."""
    norm = Normalizer(p=2.0, inputCol="features", outputCol="_n").transform(vectors)
    pca = PCA(k=k, inputCol="_n", outputCol="reduced").fit(norm)
    return pca.transform(norm).select("doc_id", "reduced")


def cluster(reduced: DataFrame, k: int = 10, seed: int = 1234, min_size: int = 5, q: float = 0.95) -> DataFrame:
    """(doc_id, topic, distance): cosine KMeans, outliers -> -1, topics renumbered by size."""
    km = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="reduced", predictionCol="cluster").fit(reduced)
    spark = reduced.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(km.clusterCenters())],
                                    "cluster int, center array<double>")   # k rows of model state
    pred = km.transform(reduced).select("doc_id", "cluster", vector_to_array("reduced").alias("v"))
    d = pred.join(F.broadcast(centers), "cluster").select("doc_id", "cluster", (1 - cosine(F.col("v"), F.col("center"))).alias("distance"))
    stats = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                     F.percentile_approx("distance", q, 10000).alias("cut"))
    order = Window.orderBy(F.desc("size"), F.asc("cluster"))
    stats = stats.withColumn("topic", (F.row_number().over(order) - 1).cast("int"))
    j = d.join(F.broadcast(stats), "cluster")
    out = F.when((F.col("size") < min_size) | (F.col("distance") > F.col("cut")), F.lit(-1)).otherwise(F.col("topic"))
    return j.select("doc_id", out.alias("topic"), "distance")


def representative_docs(assigned: DataFrame, n: int = 3) -> DataFrame:
    """The n documents closest to their cluster centre, per topic (outliers excluded)."""
    w = Window.partitionBy("topic").orderBy(F.asc("distance"), F.asc("doc_id"))
    return (assigned.where(F.col("topic") != -1).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= n).select("doc_id", "topic"))


def document_info(assigned: DataFrame, names: DataFrame, n_repr: int = 3) -> DataFrame:
    rep = representative_docs(assigned, n_repr).withColumn("representative", F.lit(True))
    return (assigned.join(F.broadcast(names.select("topic", "name")), "topic", "left")
            .join(rep, ["doc_id", "topic"], "left")
            .select("doc_id", "topic", "name", F.coalesce("representative", F.lit(False)).alias("representative")))


def central_docs(vectors: DataFrame, doc_topic: DataFrame, n: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The n documents of each topic whose vector (id, vector) is closest to the topic's mean by cosine, ties by id."""
    dims = dimensions(vectors, "vector")
    rows = vectors.join(doc_topic.select(id_col, "topic"), id_col)
    mean = mean_by(rows, "topic", "vector", dims).withColumnRenamed("vector", "mean")   # one row a topic
    near = rows.join(mean, "topic").withColumn("_s", cosine(F.transform("vector", lambda x: x.cast("double")), F.col("mean")))
    w = Window.partitionBy("topic").orderBy(F.desc("_s"), F.asc(id_col))
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(id_col, "topic")


def topic_vectors(vectors: DataFrame, representatives: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(topic, tvec ARRAY<DOUBLE>): mean vector of each topic's representative documents."""
    rows = vectors.join(representatives.where(F.col("topic") != -1).select(id_col, "topic"), id_col)
    return mean_by(rows, "topic", "vector", dimensions(vectors, "vector")).withColumnRenamed("vector", "tvec")


def rerank(candidates: DataFrame, word_vectors: DataFrame, tvecs: DataFrame, n: int = 10) -> DataFrame:
    """Re-rank candidate words (topic, term) of each topic by cosine(word vector, topic vector).

    Similarities that are equal to nine places (words of the same documents) rank by term.
    """
    j = candidates.join(word_vectors.select("term", F.col("vector").alias("wv")), "term").join(F.broadcast(tvecs), "topic")   # one row a topic
    scored = j.select("topic", "term", cosine(F.col("wv"), F.col("tvec")).alias("similarity"))
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("similarity", 9)), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mmr(candidates: DataFrame, word_vectors: DataFrame, tvecs: DataFrame, n: int = 10, diversity: float = 0.3) -> DataFrame:
    """Maximal marginal relevance over each topic's candidate words (bounded list per
    topic), one pandas group per topic.  Scores equal to nine places rank by relevance, then word."""
    import pandas as pd

    j = (candidates.join(word_vectors.select("term", F.col("vector").alias("wv")), "term").join(F.broadcast(tvecs), "topic")
         .select("topic", "term", "wv", "tvec"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf["term"].tolist()
        W = np.vstack(pdf["wv"].to_numpy())
        t = np.asarray(pdf["tvec"].iloc[0])
        Wn = W / np.maximum(np.linalg.norm(W, axis=1, keepdims=True), 1e-12)
        tn = t / max(np.linalg.norm(t), 1e-12)
        rel = np.round(Wn @ tn, 9)
        sim = np.round(Wn @ Wn.T, 9)
        order = sorted(range(len(words)), key=lambda i: (-rel[i], words[i]))
        chosen = [order[0]]
        rest = [i for i in order[1:]]
        while rest and len(chosen) < n:
            best, best_s = 0, None
            for k, i in enumerate(rest):   # rest is in (relevance desc, word) order: ties keep that order
                s_ = round((1 - diversity) * rel[i] - diversity * max(sim[i, c] for c in chosen), 9)
                if best_s is None or s_ > best_s:
                    best, best_s = k, s_
            chosen.append(rest.pop(best))
        return pd.DataFrame({"topic": [pdf["topic"].iloc[0]] * len(chosen), "rank": list(range(1, len(chosen) + 1)),
                             "term": [words[i] for i in chosen], "relevance": [float(rel[i]) for i in chosen]})

    ttype = dict(j.dtypes)["topic"]
    return j.groupBy("topic").applyInPandas(pick, f"topic {ttype}, rank int, term string, relevance double")
