"""Topic-term and document-topic tables and their summaries.

Long form everywhere: phi = (topic, term, phi), theta = (doc_id, topic, weight).
Per-topic top-n uses ``row_number() <= n`` over a topic window, which Spark
plans with a partial window-group limit before the shuffle, so a topic holding
a third of the vocabulary still ships only n rows per map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicscope.operators.blocks import Blocks, BlockTask, arrays, block_in_place, each_block, lengthened, shortened
from topicscope.staging import staged


def class_phi(dtm: DataFrame, doc_topic: DataFrame | None = None, id_col: str = "doc_id", summed: bool = False) -> DataFrame:
    """Class-conditional term distribution phi(c, w) = tf(c, w) / sum_w tf(c, w).

    ``doc_topic`` maps each document to one class (topic); when it is None the
    DTM already carries a ``topic`` column (see ``terms.dtm_long(carry=...)``)
    and no join is needed.  Per-class totals are a k-row table, so they are
    broadcast; the (class, term) aggregate is pre-combined map-side, so a
    dominant class does not overload one task.  ``summed``: ``dtm`` has one row a class and term.
    """
    src = dtm if doc_topic is None else dtm.join(doc_topic.select(id_col, "topic"), id_col)
    ct = src.select("topic", "term", F.col("n").alias("tf")) if summed else src.groupBy("topic", "term").agg(F.sum("n").alias("tf"))
    tot = ct.groupBy("topic").agg(F.sum("tf").alias("_tot"))
    return (ct.join(F.broadcast(tot), "topic")
            .select("topic", "term", "tf", (F.col("tf") / F.col("_tot")).alias("phi")))


def project(dtm_rel: DataFrame, phi: DataFrame, id_col: str = "doc_id", weight_col: str = "rel") -> DataFrame:
    """theta(d, t) = sum_w weight(d, w) * phi(t, w), aligned by term, unnormalised; topics that share no term have no row.

    A term's phi is one array over the topics, so a document-term row stays one
    row until its products are summed in its task.
    """
    labels = sorted(r[0] for r in phi.select("topic").distinct().collect())   # k labels
    by_term = phi.groupBy("term").agg(F.array(*[F.max(F.when(F.col("topic") == t, F.col("phi"))) for t in labels]).alias("_phi"))
    sums = [F.sum(F.col(weight_col) * F.col("_phi")[i]) for i in range(len(labels))]
    theta = dtm_rel.join(by_term, "term").groupBy(id_col).agg(F.array(*sums).alias("_w"))
    names = F.array(*[F.lit(t) for t in labels])
    return (theta.select(id_col, F.posexplode("_w").alias("_i", "weight")).where(F.col("weight").isNotNull())
            .select(id_col, names[F.col("_i")].alias("topic"), "weight"))


class Sums(BlockTask):
    """Count-weighted sums of a document's term arrays."""

    def __init__(self, held: list[pa.RecordBatch], k: int):
        at = np.concatenate([b.column("at").to_numpy() for b in held])
        self.c = np.zeros((int(at.max()) + 2, k))     # the last row is for terms that the table lacks
        self.c[at] = np.concatenate([b.column("c").flatten().to_numpy().reshape(-1, k) for b in held])

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(b), self.c.shape[1]))
        for r, (idx, n) in enumerate(zip(b.column("idx").to_pylist(), b.column("n").to_pylist())):
            out[r] = np.frombuffer(n, "<f8") @ self.c[np.minimum(np.frombuffer(idx, "<i4"), len(self.c) - 1)]
        yield pa.RecordBatch.from_arrays([b.column("id"), arrays(out)], names=["id", "weights"])


def project_rows(dtm: DataFrame | None, phi: DataFrame, totals: DataFrame, labels: list, id_col: str = "doc_id", pairs: int = 1 << 21, blocks: Blocks | None = None) -> DataFrame:
    """(id, weights): ``project`` of the relative frequencies n / tf as one array a document, a number for each of ``labels``.

    ``totals`` (term, tf) names the terms that count.  A term's array moves once
    a block of documents; neither a document-term row nor a product ever moves.
    A document without any of these terms may have no row.  ``blocks`` of the
    documents, where they are there, are used in place of ``dtm``.
    """
    shares = [F.coalesce(F.try_divide(F.max(F.when(F.col("topic") == t, F.col("phi"))), F.first("_tf").cast("double")), F.lit(0.0)) for t in labels]
    table = phi.select("topic", "term", "phi").join(totals.select("term", F.col("tf").alias("_tf")), "term").groupBy("term").agg(F.array(*shares).alias("c"))
    blocks = blocks or block_in_place(dtm, pairs, id_col)
    return each_block(blocks, table, lambda held: Sums(held, len(labels)), f"id {blocks.id_type}, weights array<double>").withColumnRenamed("id", id_col)


class CountSums(Sums):
    """``Sums`` of class counts over class totals and the term's total, which come as few bytes."""

    def __init__(self, held: list[pa.RecordBatch], totals: np.ndarray):
        raw, k = [x for b in held for x in b.column("c").to_pylist()], len(totals)
        n = np.array([lengthened(x) for x in raw], "f8").reshape(-1, k + 1)
        at = np.concatenate([b.column("at").to_numpy() for b in held])
        self.c = np.zeros((int(at.max()) + 2, k))     # the last row is for terms that the table lacks
        self.c[at] = n[:, :k] / totals / n[:, k:]


def project_counts(kept: DataFrame, labels: list, blocks: Blocks, id_col: str = "doc_id") -> DataFrame:
    """``project_rows`` against the class-conditional phi of class counts (topic, term, n, tf): a term's counts move in few bytes, not as phi."""
    sums = {r[0]: r[1] for r in kept.groupBy("topic").agg(F.sum("n")).collect()}      # one row a topic
    totals, k = np.array([sums[t] for t in labels], "f8"), len(labels)
    counts = [F.coalesce(F.max(F.when(F.col("topic") == t, F.col("n"))), F.lit(0)) for t in labels]
    table = kept.groupBy("term").agg(F.array(*counts, F.first("tf")).alias("c"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = b.column("c").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array(shortened(counts, list(range(0, len(counts) + 1, k + 1))), pa.binary())], names=["term", "c"])

    table = table.mapInArrow(pack, "term string, c binary")
    return each_block(blocks, table, lambda held: CountSums(held, totals), f"id {blocks.id_type}, weights array<double>", words=False).withColumnRenamed("id", id_col)


def long_rows(rows: DataFrame, labels: list) -> DataFrame:
    """Rows with an array ``weights`` as one row (..., topic, weight) for each of ``labels``."""
    names = F.array(*[F.lit(t) for t in labels]) if labels else F.array().cast("array<string>")
    keep = [c for c in rows.columns if c != "weights"]
    return rows.select(*keep, F.posexplode("weights").alias("_i", "weight")).select(keep[0], names[F.col("_i")].alias("topic"), "weight", *keep[1:])


def normalise_rows(theta: DataFrame, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(id_col)
    return theta.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(w)), F.lit(0.0)))


def top_terms(phi: DataFrame, m: int, score: str = "phi") -> DataFrame:
    """(topic, rank, term, phi): m best terms per topic, ties by term."""
    w = Window.partitionBy("topic").orderBy(F.desc(score), F.asc("term"))
    return (phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)
            .select("topic", "rank", "term", score))


def prevalence(theta: DataFrame) -> DataFrame:
    """(topic, prevalence) = column sum of theta / total * 100 (k rows)."""
    per = theta.groupBy("topic").agg(F.sum("weight").alias("_s"))
    return per.select("topic", (F.col("_s") / F.sum("_s").over(Window.partitionBy()) * 100).alias("prevalence"))


def assignments(theta: DataFrame, threshold: float = 0.05) -> DataFrame:
    return theta.where(F.col("weight") > threshold)


MASK_BITS = 62   # of a BIGINT


def coherence(dtm: DataFrame, top: DataFrame, n_docs: Column, id_col: str = "doc_id", m: int = MASK_BITS) -> DataFrame:
    """Probabilistic coherence of each topic's top-M terms; ``m`` is at least the greatest rank (checked).

    For term i (by rank) the mean over j > i of P(w_j | w_i) - P(w_j), then the
    mean over i; P from document co-occurrence.  Each document contributes one
    bit mask per topic (which top terms it holds, in as many words as ``m``
    needs); pairs are expanded from the histogram of masks, never per document.
    """
    hits = dtm.join(F.broadcast(top.select("topic", "term", "rank")), "term")
    at = F.when(F.col("rank") <= m, F.col("rank") - 1).otherwise(F.raise_error(F.lit("coherence: a rank is above m")).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at % MASK_BITS)
    words = [F.sum(F.when(F.floor(at / MASK_BITS) == w, bit).otherwise(0)) for w in range(-(-m // MASK_BITS))]
    masks = hits.groupBy(id_col, "topic").agg(F.array(*words).alias("mask"))
    hist = masks.groupBy("topic", "mask").agg(F.count(F.lit(1)).alias("cnt"))
    held = F.filter(F.sequence(F.lit(1), F.lit(m)), lambda i: F.call_function(
        "shiftright", F.get("mask", F.floor((i - 1) / MASK_BITS).cast("int")), ((i - 1) % MASK_BITS).cast("int")).bitwiseAND(1) == 1)
    held_pairs = F.flatten(F.transform("_held", lambda i: F.transform("_held", lambda j: F.struct(i.alias("i"), j.alias("j")))))
    pairs = (hist.select("topic", "cnt", held.alias("_held")).select("topic", "cnt", F.explode(held_pairs).alias("p"))
             .groupBy("topic", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("cnt").alias("co")))
    # grid, pairs and singles are bounded by k * M^2 rows (parameters, not data): broadcast
    t1 = top.select("topic", F.col("rank").alias("i"))
    t2 = F.broadcast(top.select("topic", F.col("rank").alias("j")))
    single = F.broadcast(pairs.where(F.col("i") == F.col("j")).select("topic", "i", (F.col("co") / n_docs).alias("p_i")))
    grid = (t1.join(t2, "topic").where(F.col("i") < F.col("j"))
            .join(F.broadcast(pairs), ["topic", "i", "j"], "left")
            .join(single, ["topic", "i"], "left")
            .join(single.select("topic", F.col("i").alias("j"), F.col("p_i").alias("p_j")), ["topic", "j"], "left"))
    diff = F.try_divide(F.coalesce("co", F.lit(0)) / n_docs, F.col("p_i")) - F.coalesce("p_j", F.lit(0.0))
    per_i = grid.groupBy("topic", "i").agg(F.avg(diff).alias("_c"))
    return per_i.groupBy("topic").agg(F.avg("_c").alias("coherence"))


def labels_by_assignment(dtm: DataFrame, theta: DataFrame, threshold: float = 0.05, sep: str = "_",
                         id_col: str = "doc_id") -> DataFrame:
    """Label = term maximising P(term | assigned docs) - P(term) on binary
    document-term presence; n-gram terms (containing ``sep``) are used when any exist."""
    any_ngram = dtm.where(F.col("term").contains(sep)).select(F.count(F.lit(1)) > 0).scalar()
    pres = dtm.where(F.col("term").contains(sep) | ~any_ngram).select(id_col, "term")
    df_ = pres.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    assigned = assignments(normalise_rows(theta, id_col), threshold).select(id_col, "topic")
    # one row a document and one array a term: a document's terms are not repeated for each of its topics
    labels, kind = sorted(r[0] for r in theta.select("topic").distinct().collect() if r[0] is not None), theta.schema["topic"].dataType   # k labels
    held = F.array(*[F.count(F.when(F.col("topic") == t, 1)) for t in labels]).cast("array<bigint>")
    by_doc = assigned.groupBy(id_col).agg(held.alias("_a"))
    sums = F.array(*[F.sum(F.col("_a")[i]) for i in range(len(labels))]).cast("array<bigint>")
    names = F.array(*[F.lit(t) for t in labels]).cast(T.ArrayType(kind))
    ct = (pres.join(by_doc.hint("shuffle_hash"), id_col).groupBy("term").agg(sums.alias("_a")).select("term", F.posexplode("_a").alias("_i", "_c"))
          .where(F.col("_c") > 0).select(names[F.col("_i")].alias("topic"), "term", "_c"))
    return _most_telling(ct, df_)


class AssignedHits(BlockTask):
    """For each term, the number of documents that hold it, and the sums of their arrays (0 without one)."""

    def __init__(self, held: list[pa.RecordBatch], k: int):
        self.terms, self.at = pa.concat_arrays([b.column("term") for b in held]), np.concatenate([b.column("at").to_numpy() for b in held])
        self.k, self.df, self.c = k, np.zeros(int(self.at.max()) + 1, "i8"), np.zeros((k, int(self.at.max()) + 1))

    def docs(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        idx = [np.frombuffer(x, "<i4") for x in b.column("idx").to_pylist()]
        at, row = np.concatenate(idx), np.repeat(np.arange(len(idx)), [len(x) for x in idx])
        some = at < len(self.df)
        at, row = at[some], row[some]
        self.df += np.bincount(at, minlength=len(self.df))
        flags = np.array([x or [0.0] * self.k for x in b.column("c").to_pylist()]).reshape(-1, self.k)
        for t in np.flatnonzero(flags.any(axis=0)):
            has = flags[row, t] != 0
            self.c[t] += np.bincount(at[has], flags[row[has], t], len(self.df))
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.df[self.at])
        for i in range(0, len(some), 20_000):
            at = some[i:i + 20_000]
            yield pa.RecordBatch.from_arrays([self.terms.take(pa.array(at)), pa.array(self.df[self.at[at]]), arrays(self.c[:, self.at[at]].T.astype("i8"))], names=["term", "df", "c"])


def labels_by_blocks(blocks: Blocks, kept: DataFrame, theta: DataFrame, labels: list, threshold: float = 0.05, sep: str = "_", id_col: str = "doc_id",
                     again: DataFrame | None = None) -> DataFrame:
    """``labels_by_assignment`` of the documents of blocks, of which the terms ``kept`` count: no row a document and term is made.

    ``again`` (id, term, n): how often more than once a document-term row counts.
    """
    any_ngram = kept.where(F.col("term").contains(sep)).select(F.count(F.lit(1)) > 0).scalar()
    table = kept.where(F.col("term").contains(sep) | ~any_ngram).select("term", F.array().cast("array<double>").alias("c"))
    assigned = assignments(normalise_rows(theta, id_col), threshold)
    held = F.array(*[F.count(F.when(F.col("topic") == t, 1)) for t in labels]).cast("array<double>")
    by_doc = assigned.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(held.alias("c"))
    own = Blocks(blocks.docs.join(by_doc, "id", "left").select(*blocks.docs.columns, "c"), blocks.uses, blocks.n, blocks.id_type, short=blocks.short)
    rows = each_block(own, table, lambda held: AssignedHits(held, len(labels)), "term string, df bigint, c array<bigint>")
    if again is not None:
        none = F.array_repeat(F.lit(0).cast("bigint"), len(labels))
        more = again.join(table.select("term"), "term", "left_semi").join(by_doc.withColumnRenamed("id", id_col), id_col, "left")
        rows = rows.unionByName(more.select("term", F.col("n").alias("df"), F.coalesce(F.transform("c", lambda x: (x * F.col("n")).cast("bigint")), none).alias("c")))
    sums = F.array(*[F.sum(F.col("c")[i]) for i in range(len(labels))]).cast("array<bigint>")
    got = staged(rows.groupBy("term").agg(F.sum("df").alias("_df"), sums.alias("_a")), "assigned")
    names = F.array(*[F.lit(t) for t in labels]).cast(T.ArrayType(theta.schema["topic"].dataType))
    ct = got.select("term", F.posexplode("_a").alias("_i", "_c")).where(F.col("_c") > 0).select(names[F.col("_i")].alias("topic"), "term", "_c")
    return _most_telling(ct, got.select("term", "_df"))


def _most_telling(ct: DataFrame, df_: DataFrame) -> DataFrame:
    """The best term of each topic, from (topic, term, _c) and (term, _df)."""
    total_df = df_.agg(F.sum("_df")).scalar()
    ct_tot = ct.groupBy("topic").agg(F.sum("_c").alias("_ct"))
    scored = (ct.join(F.broadcast(ct_tot), "topic").join(df_, "term")
              .select("topic", "term", (F.col("_c") / F.col("_ct") - F.col("_df") / total_df).alias("p_diff")))
    w = Window.partitionBy("topic").orderBy(F.desc("p_diff"), F.asc("term"))
    return (scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("topic", F.col("term").alias("label")))


def topic_given_word(phi: DataFrame, theta: DataFrame) -> DataFrame:
    """Gamma(t, w) = phi(t, w) p(t) / sum_t' phi(t', w) p(t'), p(t) from theta column sums."""
    pt = theta.groupBy("topic").agg(F.sum("weight").alias("_s"))
    pt = pt.select("topic", (F.col("_s") / F.sum("_s").over(Window.partitionBy())).alias("p_topic"))
    num = phi.join(F.broadcast(pt), "topic").select("topic", "term", (F.col("phi") * F.col("p_topic")).alias("_g"))
    return num.select("topic", "term", (F.col("_g") / F.sum("_g").over(Window.partitionBy("term"))).alias("gamma"))


def summary(top: DataFrame, prev: DataFrame, coh: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(topic, label, coherence, prevalence, top_terms): numbers rounded half-even to 3
    places, terms joined by ", " in rank order; label defaults to the first top term."""
    terms = (top.groupBy("topic")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
             .select("topic", F.transform("_t", lambda s: s["term"]).alias("_terms")))
    out = terms.join(prev, "topic", "left")
    out = out.join(coh, "topic", "left") if coh is not None else out.withColumn("coherence", F.col("prevalence"))
    if labels is not None:
        out = out.join(labels, "topic", "left")
    else:
        out = out.withColumn("label", F.col("_terms")[0])
    return out.select("topic", "label", F.bround("coherence", 3).alias("coherence"),
                      F.bround("prevalence", 3).alias("prevalence"),
                      F.array_join("_terms", ", ").alias("top_terms"))
