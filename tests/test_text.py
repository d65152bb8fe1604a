import re

from pyspark.sql import functions as F

from topicscope.functions import text as tx
from topicscope.functions.stopwords import SNOWBALL_EN
from topicscope.operators import terms


def py_tokens(s):
    return re.findall(r"[^\W\d_]+", s.lower()) if s is not None else None


def test_tokens_match_python(spark, tiny_corpus):
    got = {r.doc_id: r.t for r in tiny_corpus.select("doc_id", tx.tokens("text").alias("t")).collect()}
    for r in tiny_corpus.collect():
        assert got[r.doc_id] == py_tokens(r.text)


def test_ngrams_brute_force(spark, tiny_corpus):
    spec = terms.DtmSpec(ngram=(1, 3), stopwords=SNOWBALL_EN)
    got = {r.doc_id: r.terms for r in terms.term_arrays(tiny_corpus, spec).collect()}
    for r in tiny_corpus.collect():
        toks = [t for t in py_tokens(r.text) if t not in SNOWBALL_EN]
        want = []
        for n in (1, 2, 3):
            want += ["_".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
        assert got[r.doc_id] == want


def test_dtm_counts_and_empty_docs(spark, tiny_corpus):
    spec = terms.DtmSpec(stopwords=SNOWBALL_EN)
    dtm = terms.dtm_long(tiny_corpus, spec)
    counts = {(r.doc_id, r.term): r.n for r in dtm.collect()}
    assert counts[(8, "dog")] == 3 and counts[(8, "cat")] == 2
    assert not any(k[0] in (2, 3) for k in counts)          # empty / stop-word-only documents
    lens = {r.doc_id: r.n_tokens for r in terms.instance_lengths(tiny_corpus, dtm).collect()}
    assert lens[2] == 0 and lens[3] == 0 and lens[8] == 5   # kept with zero length


def test_doc_length_rules(spark, tiny_corpus):
    got = {r.doc_id: r.n for r in tiny_corpus.select("doc_id", tx.doc_length("text").alias("n")).collect()}
    assert got[2] == 0              # empty text
    assert got[4] == 5              # leading blank counts one empty piece
    assert got[5] == 2              # trailing blanks count nothing


def test_remove_word_unicode_boundaries(spark):
    rows = [(1, "le chat le"), (2, "élever le"), (3, "lé le é le"), (4, "le_le le")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", tx.remove_word("text", "le").alias("t")).collect()}
    for i, s in rows:
        assert got[i] == re.sub(r"\ble\b", "", s)


def test_strip_digits(spark, tiny_corpus):
    r = tiny_corpus.where("doc_id = 6").select(tx.strip_digits("text").alias("t")).collect()[0]
    assert r.t == "digits  and five mixed"
