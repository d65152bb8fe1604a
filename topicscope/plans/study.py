"""The shared topic study behind the registered queries.

All documents -> unigram DTM (Snowball stop words) -> threshold trim
(total > 4) -> fixed topic-term matrix phi = class-conditional term
distribution with topic = ``source`` -> theta = sum_w rel(d, w) phi(t, w)
(relative frequency = n / term total) -> dense theta over every document x
topic (missing = 0), ready to be joined with outcomes.

Everything is lazy; each attribute is one DataFrame.  The stage tables that
many branches of a query read (document-term table, phi, theta, top terms)
are persisted MEMORY_AND_DISK: otherwise each branch re-derives them with
differently pruned plans that exchange reuse cannot merge.  Persisted blocks
are rebuilt from lineage when an executor is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicscope.functions.stopwords import SNOWBALL_EN, split_ngram_stopwords
from topicscope.operators import terms, topics, vocab
from topicscope.operators.blocks import Blocks, block_terms, by_class, held_pairs
from topicscope.operators.sift import sifted_blocks
from topicscope.sources.tables import documents, gathered, read_table, spread
from topicscope.staging import staged

# Fixed parameters of the registered study.
LANG = None        # all languages
TRIM_LEAST = 4
TRIM_MOST = None   # no upper bound: an absolute one would bite only as data grow
TOP_M = 10


def _keep(df: DataFrame, mode: str = "persist") -> DataFrame:
    """persist: MEMORY_AND_DISK, rebuilt from lineage on executor loss (default);
    checkpoint: written once to the shared ``spark.checkpoint.dir`` (eager), lineage
    cut, nothing recomputed after an executor loss; for very large corpora."""
    if mode == "checkpoint":
        from topicscope.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Study:
    spark: SparkSession
    sf_dir: str
    ngram: tuple[int, int] = (1, 1)
    least: int | None = TRIM_LEAST
    most: int | None = TRIM_MOST
    top_m: int = TOP_M
    lang: str | None = LANG
    materialize: str = "persist"

    @property
    def spec(self) -> terms.DtmSpec:
        return terms.DtmSpec(ngram=self.ngram, stopwords=SNOWBALL_EN)

    @cached_property
    def docs(self) -> DataFrame:
        return documents(self.spark, self.sf_dir, self.lang).select("doc_id", "text", "source", "n_chars")

    @cached_property
    def n_docs(self):
        return self.docs.select(F.count(F.lit(1))).scalar()

    @cached_property
    def dtm_topic(self) -> DataFrame:
        """(doc_id, topic, term, n), persisted: every branch of a query (totals,
        trim, phi, relative frequency, coherence, labels) reads it, so texts are
        tokenised once; the document's class rides along, so phi needs no join."""
        docs = self.docs.withColumnRenamed("source", "topic")
        docs = spread(docs, "doc_id", always=True)     # texts move once, not their terms
        return _keep(terms.dtm_long(docs, self.spec, carry=("topic",)), self.materialize)

    @cached_property
    def packed(self) -> Blocks:
        """All documents in blocks, each with its term counts as packed numbers: what phi, theta and coherence read,
        at a small part of the document-term table's size.  N-grams that the trim surely drops are not even made strings."""
        spec, most = self.spec, split_ngram_stopwords(self.spec.stopwords, self.spec.sep)[1]
        if self.least is not None and self.ngram != (1, 1) and not most:
            docs = self.docs.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text")
            have, cores = docs.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism
            return sifted_blocks(docs, terms.token_columns(spec), max(4 * have, 2 * cores), self.least, (*self.ngram, spec.sep))
        docs = gathered(spread(self.docs.withColumnRenamed("source", "topic"), "doc_id", always=True).sortWithinPartitions("doc_id", "topic"))
        return block_terms(terms.kept_arrays(docs, self.spec, ("topic",)).withColumnRenamed("doc_id", "id"), pairs=1 << 22)

    def held(self, some: DataFrame) -> DataFrame:
        """(doc_id, term, n): the document-term rows of a few terms (those at the top)."""
        return held_pairs(self.packed, some, few=True).withColumnRenamed("id", "doc_id")

    @cached_property
    def again(self) -> DataFrame | None:
        """(doc_id, term, n): in how many classes more than one an id holds a term; None where no id is in several."""
        docs = self.docs.withColumnRenamed("source", "topic")
        many = staged(docs.select("doc_id", "topic").distinct().groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), "many-classes")
        if many.isEmpty():
            return None
        rows = terms.dtm_long(docs.join(many, docs["doc_id"].eqNullSafe(many["id"]), "left_semi"), self.spec, carry=("topic",))
        return rows.groupBy("doc_id", "term").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")

    @cached_property
    def class_kept(self) -> DataFrame:
        """(topic, term, n, tf): counts by class of the terms that are kept, and their totals.  Dealt out by term once."""
        counts = by_class(self.packed.words.repartition("term")).groupBy("term", "topic").agg(F.sum("n").alias("n")).select("topic", "term", "n")
        total = Window.partitionBy("term")
        return staged(vocab.keep_by_threshold(counts.withColumn("tf", F.sum("n").over(total)), self.least, self.most), "class-kept")

    @cached_property
    def kept_totals(self) -> DataFrame:
        """(term, tf) of the terms that are kept."""
        return self.class_kept.groupBy("term").agg(F.first("tf").alias("tf"))

    @cached_property
    def dtm_full(self) -> DataFrame:
        return self.dtm_topic.select("doc_id", "term", "n")

    @cached_property
    def totals_full(self) -> DataFrame:
        return _keep(self.class_terms.groupBy("term").agg(F.sum("n").alias("tf"), F.sum("df").alias("df")), self.materialize)

    @cached_property
    def kept(self) -> DataFrame:
        return vocab.keep_by_threshold(self.totals_full, self.least, self.most)

    @cached_property
    def dtm_t(self) -> DataFrame:
        return _keep(vocab.restrict(self.dtm_topic, self.kept), self.materialize)

    @cached_property
    def dtm(self) -> DataFrame:
        return self.dtm_t.select("doc_id", "term", "n")

    @cached_property
    def doc_topic(self) -> DataFrame:
        return self.docs.select("doc_id", F.col("source").alias("topic"))

    @cached_property
    def class_terms(self) -> DataFrame:
        """(topic, term, n): counts by class, of the whole vocabulary."""
        return _keep(self.dtm_topic.groupBy("topic", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df")), self.materialize)

    @cached_property
    def phi(self) -> DataFrame:
        return topics.class_phi(self.class_kept, summed=True)

    @cached_property
    def rel(self) -> DataFrame:
        return vocab.relative_frequency(self.dtm, self.kept)

    @cached_property
    def theta_sparse(self) -> DataFrame:
        return topics.project(self.rel, self.phi)

    @cached_property
    def topic_list(self) -> list:
        """Sorted topic ids (k values, k = number of topics)."""
        return sorted(r[0] for r in self.phi_topics.collect())

    @property
    def phi_topics(self) -> DataFrame:
        return self.class_kept.where("topic IS NOT NULL").select("topic").distinct()

    @cached_property
    def theta_rows(self) -> DataFrame:
        """Dense theta as (doc_id, weights), one row a row of ``docs``: a document's weights by topic, 0 where no term is shared."""
        none = F.array_repeat(F.lit(0.0), len(self.topic_list))
        got = topics.project_counts(self.class_kept, self.topic_list, self.packed)
        return _keep(self.docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("weights", none).alias("weights")), self.materialize)

    @cached_property
    def theta(self) -> DataFrame:
        """Dense theta: every document x every topic."""
        return topics.long_rows(self.theta_rows, self.topic_list)

    @cached_property
    def top(self) -> DataFrame:
        return _keep(topics.top_terms(self.phi, self.top_m), self.materialize)

    @cached_property
    def prevalence(self) -> DataFrame:
        return topics.prevalence(self.theta)

    @cached_property
    def coherence(self) -> DataFrame:
        return topics.coherence(self.held(self.top), self.top, self.n_docs, m=self.top_m)

    @cached_property
    def summary(self) -> DataFrame:
        return topics.summary(self.top, self.prevalence, self.coherence)

    @cached_property
    def labels(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "labels")

    def loadings_with(self, cols: list[str], source: str = "labels") -> DataFrame:
        """Dense theta joined with outcome columns (complete cases)."""
        from topicscope.operators.stats import attach_outcomes
        if source == "labels":
            out = self.labels
        else:
            out = self.docs.select("doc_id", *cols)
        return self.loadings(attach_outcomes(self.theta_rows, out, cols))

    def loadings(self, rows: DataFrame) -> DataFrame:
        """Joined rows of ``theta_rows`` as one row a document and topic: outcomes are joined before this, not after."""
        return topics.long_rows(rows, self.topic_list)
