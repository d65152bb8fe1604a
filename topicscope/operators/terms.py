"""Tokens, n-grams and the long-form document-term table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.functions import text as tx
from topicscope.functions.stopwords import split_ngram_stopwords


@dataclass(frozen=True)
class DtmSpec:
    """How texts become terms: n-gram window, stop words, joiner, min token length."""
    id_col: str = "doc_id"
    text_col: str = "text"
    ngram: tuple[int, int] = (1, 1)
    stopwords: tuple[str, ...] = field(default_factory=tuple)
    sep: str = "_"
    min_token_len: int = 1


def term_arrays(docs: DataFrame, spec: DtmSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, [carry...], terms ARRAY<STRING>): tokens, unigram stop words removed, n-grams built."""
    uni, _ = split_ngram_stopwords(spec.stopwords, spec.sep)
    toks = tx.min_length(tx.drop_words(tx.tokens(spec.text_col), uni), spec.min_token_len)
    # Tokens become a column first; the n-gram lambdas then slice that column
    # instead of re-evaluating the tokeniser for every n-gram position.
    keep = [F.col(spec.id_col)] + [F.col(c) for c in carry]
    t = docs.select(*keep, toks.alias("_toks"))
    if spec.ngram == (1, 1):
        return t.withColumnRenamed("_toks", "terms")
    return t.select(*keep, tx.ngrams("_toks", spec.ngram[0], spec.ngram[1], spec.sep).alias("terms"))


def token_columns(spec: DtmSpec):
    """What makes ``text`` a column ``tokens``: single tokens, without the stop words that are one."""
    def columns(rows: DataFrame) -> DataFrame:
        one = replace(spec, id_col="part", text_col="text", ngram=(1, 1))
        return term_arrays(rows, one, tuple(c for c in rows.columns if c not in ("part", "text"))).withColumnRenamed("terms", "tokens")
    return columns


def kept_arrays(docs: DataFrame, spec: DtmSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """``term_arrays`` without the n-gram stop words."""
    _, multi = split_ngram_stopwords(spec.stopwords, spec.sep)
    out = term_arrays(docs, spec, carry)
    return out.withColumn("terms", tx.drop_words("terms", multi)) if multi else out


def explode_terms(docs: DataFrame, spec: DtmSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, [carry...], term) one row per n-gram occurrence; n-gram stop words removed."""
    _, multi = split_ngram_stopwords(spec.stopwords, spec.sep)
    out = explode_array(term_arrays(docs, spec, carry), "terms", "term", [spec.id_col, *carry])
    return out.where(~F.col("term").isin(multi)) if multi else out


def explode_array(df: DataFrame, col: str, out: str, keep: list[str]) -> DataFrame:
    """explode_outer + null filter instead of explode: a plain explode makes the
    optimizer infer ``size(array) > 0`` and push it below the scan-side
    repartition, where the whole tokeniser would be inlined and run twice in
    one task."""
    return df.select(*keep, F.explode_outer(col).alias(out)).where(F.col(out).isNotNull())


def dtm_long(docs: DataFrame, spec: DtmSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """Document-term table (id, [carry...], term, n BIGINT).

    Aggregated right after the explode (map-side partial aggregation), so a long
    document never leaves its task un-aggregated.  ``carry`` keeps per-document
    attributes (e.g. a class label) on every row, which spares a later join of
    the whole table with the documents.
    """
    return (explode_terms(docs, spec, carry)
            .groupBy(spec.id_col, *carry, "term")
            .agg(F.count(F.lit(1)).alias("n")))


def term_totals(dtm: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, tf = total count, df = number of documents)."""
    return dtm.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def instance_lengths(docs: DataFrame, dtm: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokens per vectorised document; documents without terms get 0."""
    lens = dtm.groupBy(id_col).agg(F.sum("n").alias("n_tokens"))
    return (docs.select(id_col).join(lens, id_col, "left")
            .select(id_col, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))


def frozen_vocab_dtm(docs: DataFrame, spec: DtmSpec, vocabulary: DataFrame) -> DataFrame:
    """Vectorise new texts against a frozen vocabulary (term column): unknown terms drop."""
    return dtm_long(docs, spec).join(vocabulary.select("term"), "term", "left_semi")


def dtm_to_docs(dtm: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pseudo-documents: each term repeated n times, terms in sorted order."""
    return (dtm.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("tn"))
            .select(id_col, F.array_join(F.flatten(F.transform("tn", lambda s: F.array_repeat(s["term"], s["n"].cast("int")))), " ").alias("pseudo_text")))


def tfidf(dtm: DataFrame, n_docs, id_col: str = "doc_id") -> DataFrame:
    """tf-idf with Spark's IDF rule: n * ln((N + 1) / (df + 1))."""
    df_ = dtm.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (dtm.join(df_, "term")
            .select(id_col, "term", "n", (F.col("n") * F.ln((F.lit(n_docs) + 1) / (F.col("df") + 1))).alias("tfidf")))
