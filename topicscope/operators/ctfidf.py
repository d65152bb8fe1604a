"""Class-based TF-IDF and the embedding-topic result tables.

A "class document" is every text of one topic; its term counts come from one
``groupBy(topic, term)`` (map-side combined, so a dominant topic is not one
task).  Per-topic totals and the vocabulary-wide term totals are joined back;
topic-level tables (k rows) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicscope.functions import text as tx
from topicscope.operators import terms
from topicscope.operators.blocks import BlockTask, block_sequences, by_class, each_block
from topicscope.operators.sift import sifted_blocks
from topicscope.staging import staged

#: Numbers that a block of documents holds, and window positions worked on together.
BLOCK_CELLS, SLICE = 1 << 25, 1 << 15


OUTLIER = -1


def class_documents(docs: DataFrame, class_col: str = "source") -> DataFrame:
    """``docs`` with ``topic``: the classes numbered from 0 by code point; documents without a class are the outlier topic."""
    classes = docs.select(class_col).where(F.col(class_col).isNotNull()).distinct()   # one row a topic
    numbers = classes.select(F.col(class_col).alias("_class"), (F.row_number().over(Window.orderBy(class_col)) - 1).cast("int").alias("topic"))
    return (docs.join(F.broadcast(numbers), docs[class_col] == numbers["_class"], "left").drop("_class")     # texts stay where they are
            .withColumn("topic", F.coalesce("topic", F.lit(OUTLIER))))


def class_term_counts(docs: DataFrame, spec: terms.DtmSpec, topic_col: str = "topic", carry: tuple[str, ...] = ()) -> DataFrame:
    """(topic, [carry...], term, tf): n-grams are built inside each document (never across two)."""
    t = terms.term_arrays(docs, spec, (topic_col, *carry)).withColumnRenamed(topic_col, "topic")
    return terms.explode_array(t, "terms", "term", ["topic", *carry]).groupBy("topic", *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def class_term_counts_from(docs: DataFrame, spec: terms.DtmSpec, class_col: str, min_df: int, id_col: str = "doc_id") -> DataFrame:
    """``class_term_counts`` of the n-grams of ``min_df`` classes or more (of a few others too): what fewer classes have is not made strings."""
    classes = sorted(r[0] for r in docs.select(class_col).where(F.col(class_col).isNotNull()).distinct().collect())   # one row a class
    parts = max(4 * docs.rdd.getNumPartitions(), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    docs = docs.select(F.col(id_col).alias("id"), F.col(class_col).alias("topic"), F.col(spec.text_col).alias("text"))
    held = sifted_blocks(docs, terms.token_columns(spec), parts, min_df - 1, (*spec.ngram, spec.sep), classes=classes)
    return by_class(held.words.repartition("term")).groupBy("term", "topic").agg(F.sum("n").alias("tf")).select("topic", "term", "tf")


def min_class_freq(ct: DataFrame, min_df: int) -> DataFrame:
    """Terms present in at least ``min_df`` classes."""
    return (ct.groupBy("term").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("tf").alias("tf"))
            .where(F.col("n_classes") >= min_df))


def ctfidf(ct: DataFrame, bm25: bool = False, reduce_frequent: bool = False) -> DataFrame:
    """(topic, term, tf, score): L1-normalised class tf (sqrt if reduce_frequent)
    times idf = ln(1 + A / f_term), A = int(mean tokens per class); bm25:
    idf = ln(1 + (A - f + 0.5) / (f + 0.5))."""
    per_topic = ct.groupBy("topic").agg(F.sum("tf").alias("_ttot"))
    a = per_topic.select(F.floor(F.avg("_ttot")).cast("double")).scalar()
    f = ct.groupBy("term").agg(F.sum("tf").alias("_f"))
    j = ct.join(F.broadcast(per_topic), "topic").join(f, "term")
    norm = F.col("tf") / F.col("_ttot")
    if reduce_frequent:
        norm = F.sqrt(norm)
    if bm25:
        idf = F.ln(1 + (a - F.col("_f") + 0.5) / (F.col("_f") + 0.5))
    else:
        idf = F.ln(a / F.col("_f") + 1)
    return j.select("topic", "term", "tf", (norm * idf).alias("score"))


def top_words(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(topic, rank, term, score): n best terms per topic (window-group limit, ties by term)."""
    w = Window.partitionBy("topic").orderBy(F.desc(score), F.asc("term"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("topic", "rank", "term", score)


def topic_sizes(docs: DataFrame, topic_col: str = "topic") -> DataFrame:
    return docs.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("size"))


def topic_info(sizes: DataFrame, top: DataFrame, name_words: int = 4) -> DataFrame:
    """(topic, size, name): name = '<topic>_' + first words joined by '_'."""
    words = (top.where(F.col("rank") <= name_words).groupBy("topic")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w")))
    return (sizes.join(words, "topic", "left")
            .select("topic", "size", F.concat_ws("_", F.col("topic").cast("string"),
                                                  F.array_join(F.transform("_w", lambda s: s["term"]), "_")).alias("name")))


def summary_embed(top: DataFrame, outlier: int = -1) -> DataFrame:
    """(topic_name 't_i', words 'w1, w2, ...'): outlier topic left out, renumbered from 1."""
    t = top.where(F.col("topic") != outlier)
    words = t.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w"))
    idx = F.dense_rank().over(Window.orderBy("topic"))
    return words.select(F.concat(F.lit("t_"), idx.cast("string")).alias("topic_name"),
                        F.array_join(F.transform("_w", lambda s: s["term"]), ", ").alias("words"))


def word_map(top: DataFrame, score: str = "score") -> DataFrame:
    """(topic, words MAP<term, score>) for word-cloud input."""
    return top.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("term", score))).alias("words"))


def barchart(sizes: DataFrame, top: DataFrame, n_topics: int = 30, n_words: int = 5) -> DataFrame:
    """Top topics by size (ties by topic id), each with its n_words best terms."""
    best = sizes.orderBy(F.desc("size"), F.asc("topic")).limit(n_topics)
    return top.where(F.col("rank") <= n_words).join(F.broadcast(best), "topic")


def topic_norms(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.groupBy("topic").agg(F.sqrt(F.sum(F.col(score) * F.col(score))).alias("norm"))


def topic_distance(scores: DataFrame, score: str = "score") -> DataFrame:
    """Cosine similarity / distance for every pair of topics (t1 < t2) from their
    score vectors: self-join on term (at most k rows per term, so k^2/2 products
    per term), then one aggregate per pair."""
    a = scores.select(F.col("topic").alias("topic_1"), "term", F.col(score).alias("s1"))
    b = scores.select(F.col("topic").alias("topic_2"), "term", F.col(score).alias("s2"))
    dots = (a.join(b, "term").where(F.col("topic_1") < F.col("topic_2"))
            .groupBy("topic_1", "topic_2").agg(F.sum(F.col("s1") * F.col("s2")).alias("dot")))
    n = topic_norms(scores, score)
    n1 = F.broadcast(n.select(F.col("topic").alias("topic_1"), F.col("norm").alias("n1")))
    n2 = F.broadcast(n.select(F.col("topic").alias("topic_2"), F.col("norm").alias("n2")))
    pairs = n1.join(n2, F.col("topic_1") < F.col("topic_2"))
    out = pairs.join(dots, ["topic_1", "topic_2"], "left")
    sim = F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("n1") * F.col("n2"))
    return out.select("topic_1", "topic_2", sim.alias("similarity"), (1 - sim).alias("distance"))


class Windows(BlockTask):
    """Similarities of a block's token windows with all topics.

    ``c`` of a term is its idf and its scores by topic.  A window's vector is its
    term counts x idf, so its product with a topic is a sliding sum over token
    positions; its norm adds the products of equal terms in the window.
    """

    def __init__(self, held: list[pa.RecordBatch], labels: pa.Array, norms: np.ndarray, window: int, least: float, by_token: bool):
        self.labels, self.window, self.least, self.by_token, k = labels, window, least, by_token, len(labels)
        at = np.concatenate([b.column("at").to_numpy() for b in held])
        order = np.argsort(at)
        self.words = pa.concat_arrays([b.column("term") for b in held]).take(pa.array(order))
        self.idf, self.pull = np.zeros(len(at)), np.zeros((len(at), k))
        for b in held:
            known = b.filter(b.column("c").is_valid())
            if known.num_rows:
                c = known.column("c").flatten().to_numpy().reshape(-1, k + 1)
                where = known.column("at").to_numpy()
                self.idf[where] = c[:, 0]
                self.pull[where] = c[:, :1] * np.divide(c[:, 1:], norms, out=np.zeros_like(c[:, 1:]), where=norms > 0)

    def similarities(self, idx: np.ndarray, first: int, last: int) -> np.ndarray:
        """Of windows first..last - 1 with every topic; below ``least`` they are 0."""
        width, n = min(self.window, len(idx)), last - first
        pull, square = np.zeros((n, self.pull.shape[1])), np.zeros(n)
        cut = [idx[first + o:last + o] for o in range(width)]
        for o in range(width):
            pull += self.pull[cut[o]]
            square += self.idf[cut[o]] ** 2
            for before in range(o):
                square += np.where(cut[o] == cut[before], 2 * self.idf[cut[o]] ** 2, 0.0)
        sim = np.divide(pull, np.sqrt(square)[:, None], out=np.zeros_like(pull), where=square[:, None] > 0)
        sim[sim < self.least] = 0.0
        return sim

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, out = [], []
        for row, raw in enumerate(b.column("idx").to_pylist()):
            idx = np.frombuffer(raw, "<i4")
            windows = max(len(idx) - self.window + 1, 1)
            if not self.by_token:
                s = sum(self.similarities(idx, i, min(i + SLICE, windows)).sum(axis=0) for i in range(0, windows, SLICE))
                topic = np.flatnonzero(s > 0)
                rows.append(np.full(len(topic), row))
                out.append((topic, s[topic] / s.sum()))
                continue
            for i in range(0, len(idx), SLICE):   # tokens i..j-1 and the windows that cover them
                j, width = min(i + SLICE, len(idx)), min(self.window, len(idx))
                first, last = max(0, i - width + 1), min(windows, j)
                weight, sim = np.zeros((j - i, self.pull.shape[1])), self.similarities(idx, first, last)
                for o in range(width):            # window w covers the tokens w..w + width - 1
                    lo, hi = max(first + o, i), min(last + o, j)
                    if lo < hi:
                        weight[lo - i:hi - i] += sim[lo - o - first:hi - o - first]
                pos, topic = np.nonzero(weight > 0)
                if len(pos):
                    yield self._batch(b, np.full(len(pos), row), topic, weight[pos, topic], i + pos, idx)
        if rows and sum(map(len, rows)):
            yield self._batch(b, np.concatenate(rows), np.concatenate([t for t, _ in out]), np.concatenate([w for _, w in out]))

    def _batch(self, b: pa.RecordBatch, row: np.ndarray, topic: np.ndarray, weight: np.ndarray, pos: np.ndarray | None = None, idx=None) -> pa.RecordBatch:
        labels = self.labels.take(pa.array(topic))
        cols = {"id": b.column("id").take(pa.array(row)), "topic": labels, "weight": pa.array(weight)}
        if pos is not None:
            cols |= {"pos": pa.array(pos.astype("i4")), "token": self.words.take(pa.array(idx[pos]))}
        return pa.RecordBatch.from_pydict(cols)


def _over_windows(docs: DataFrame, scores: DataFrame, idf: DataFrame, window: int, min_similarity: float, id_col: str, text_col: str, by_token: bool) -> DataFrame:
    norms = {r.topic: r.norm for r in topic_norms(scores).collect()}   # one row a topic
    labels = sorted(norms)
    by_term = scores.groupBy("term").agg(*[F.coalesce(F.max(F.when(F.col("topic") == t, F.col("score"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(labels)])
    table = by_term.join(idf, "term").select("term", F.array(F.col("idf"), *[F.col(f"s{i}") for i in range(len(labels))]).alias("c"))
    tokens = docs.select(id_col, tx.min_length(tx.tokens(text_col), 2).alias("tokens"))
    blocks = block_sequences(tokens, id_col, "tokens", len(labels) + 1, BLOCK_CELLS)
    schema = f"id {blocks.id_type}, topic {scores.schema['topic'].dataType.simpleString()}, weight double" + (", pos int, token string" if by_token else "")
    values = np.array([norms[t] for t in labels])
    kind = pa.int32() if scores.schema["topic"].dataType.simpleString() == "int" else None
    return each_block(blocks, table, lambda held: Windows(held, pa.array(labels, kind), values, window, min_similarity, by_token), schema, "left").withColumnRenamed("id", id_col)


def approx_distribution(docs: DataFrame, scores: DataFrame, idf: DataFrame, window: int = 4, min_similarity: float = 0.1, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(id, topic, weight): document-topic distribution from token windows (window tokens, stride 1).

    Each window's term counts become an L1-normalised tf x idf vector (terms
    without scores, such as stop words, are 0); its cosine similarity with every
    topic vector below ``min_similarity`` is set to 0; similarities are summed per
    document and normalised to 1.  A document shorter than the window is one
    window.  Texts do not move, only their term numbers, by block; windows are arrays in the
    document's row, and a term's scores move once a block.
    """
    return _over_windows(docs, scores, idf, window, min_similarity, id_col, text_col, False)


def token_distribution(docs: DataFrame, scores: DataFrame, idf: DataFrame, window: int = 4, min_similarity: float = 0.1, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, pos, token, topic, weight): for every token position, the sum of the
    (thresholded) window-topic similarities of the windows that cover it."""
    return _over_windows(docs, scores, idf, window, min_similarity, id_col, text_col, True).select(id_col, "pos", "token", "topic", "weight")


def idf_table(ct: DataFrame, bm25: bool = False) -> DataFrame:
    per_topic = ct.groupBy("topic").agg(F.sum("tf").alias("_ttot"))
    a = per_topic.select(F.floor(F.avg("_ttot")).cast("double")).scalar()
    f = ct.groupBy("term").agg(F.sum("tf").alias("_f"))
    idf = F.ln(1 + (a - F.col("_f") + 0.5) / (F.col("_f") + 0.5)) if bm25 else F.ln(a / F.col("_f") + 1)
    return f.select("term", idf.alias("idf"))


def topics_per_class(docs: DataFrame, spec: terms.DtmSpec, class_col: str, n_words: int = 5) -> DataFrame:
    """(topic, class, frequency, words): documents per topic x class and the best
    words of each cell, scored by cell-normalised tf times the global idf."""
    docs = docs.withColumnRenamed(class_col, "class")
    cell = staged(class_term_counts(docs, spec, carry=("class",)), "class-cells")   # texts are read once
    idf = idf_table(cell.groupBy("topic", "term").agg(F.sum("tf").alias("tf")))
    tot = cell.groupBy("topic", "class").agg(F.sum("tf").alias("_tot"))
    sc = cell.join(tot, ["topic", "class"]).join(idf, "term") \
        .select("topic", "class", "term", (F.col("tf") / F.col("_tot") * F.col("idf")).alias("s"))
    w = Window.partitionBy("topic", "class").orderBy(F.desc("s"), F.asc("term"))
    best = sc.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_words)
    words = best.groupBy("topic", "class").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), ", ").alias("words"))
    freq = docs.groupBy("topic", "class").agg(F.count(F.lit(1)).alias("frequency"))
    return freq.join(words, ["topic", "class"], "left").select("topic", "class", "frequency", "words")


def topic_hierarchy(pairs: DataFrame, dist: str = "distance") -> DataFrame:
    """Single-linkage hierarchy of topics as merge heights (cophenetic distances).

    The height at which topics a and b join one cluster is the min-max path
    distance between them.  Starting from the k x k distance table (diagonal 0),
    each round composes D'(a, b) = min_c max(D(a, c), D(c, b)); after
    ceil(log2 k) rounds paths of any length are covered.  Every round is one join
    and one aggregate over k^3 rows (k = number of topics) and is checkpointed to
    the shared checkpoint folder, so the plan does not double per round.
    Output: (topic_1 < topic_2, merge_distance); thresholding it at any height
    gives the clusters of that level.
    """
    import math

    from topicscope.session import checkpoint_dir

    spark = pairs.sparkSession
    checkpoint_dir(spark)
    p = pairs.select(F.col("topic_1").alias("i"), F.col("topic_2").alias("j"), F.col(dist).alias("d"))
    nodes = p.select(F.col("i").alias("t")).union(p.select(F.col("j").alias("t"))).distinct()
    full = (p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
            .unionByName(nodes.select(F.col("t").alias("i"), F.col("t").alias("j"), F.lit(0.0).alias("d"))))
    full = full.checkpoint()
    k = nodes.count()
    for _ in range(max(1, math.ceil(math.log2(max(k, 2))))):
        a = full.select("i", F.col("j").alias("c"), F.col("d").alias("d1"))
        b = full.select(F.col("i").alias("c"), "j", F.col("d").alias("d2"))
        full = (a.join(b, "c").groupBy("i", "j").agg(F.min(F.greatest("d1", "d2")).alias("d"))).checkpoint()
    return full.where(F.col("i") < F.col("j")).select(F.col("i").alias("topic_1"), F.col("j").alias("topic_2"),
                                                      F.col("d").alias("merge_distance"))
