"""N-grams that the trim drops are left out before they are strings; all others keep their counts."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicscope.operators import blocks as B
from topicscope.operators import sift

DOCS = [(1, "a", "x y x y"), (1, "a", "y z"), (1, "b", "x y"), (2, "b", "z z x y"), (3, None, "x w"), (None, "a", "y x y"), (None, "a", "y y"), (4, "a", ""), (5, "a", None), (6, "b", "w")]


def grams(text, lo=1, hi=3):
    t = (text or "").split()
    return ["_".join(t[i:i + n]) for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


@pytest.mark.parametrize("least", [0, 2, 4])
@pytest.mark.parametrize("parts", [1, 5])
def test_sifted_counts(spark, least, parts):
    docs = spark.createDataFrame(DOCS, "id bigint, topic string, text string")
    tokens = lambda rows: rows.withColumn("tokens", F.when(F.col("text") != "", F.split("text", " "))).drop("text")
    blocks = sift.sifted_blocks(docs, tokens, parts, least, (1, 3, "_"))
    total = Counter(g for *_, t in DOCS for g in grams(t))
    kept = {g for g, n in total.items() if n > least}
    words = {r.term for r in blocks.uses.collect()}
    assert words == kept             # the few hashes do not collide
    got = Counter()
    for r in blocks.classes.collect():
        got[r.topic, r.term] += r.n
    assert got == Counter((c, g) for _, c, t in DOCS for g in grams(t) if g in kept)
    pairs = Counter({(r.id, r.term): r.n for r in B.held_pairs(blocks, blocks.uses).collect()})
    assert pairs == Counter((i, g) for i, _, t in DOCS for g in grams(t) if g in kept)


def test_grams_of_slices():
    rows = pa.array([["q"], ["a", "b", "c"], None, [], ["b", "c"]]).slice(1)
    made = list(sift.Grams(1, 3, " ").each(rows))
    words = [(strings(np.arange(len(keys))).to_pylist(), row.tolist()) for keys, row, strings in made]
    assert words == [(["a", "b", "c", "b", "c"], [0, 0, 0, 3, 3]), (["a b", "b c", "b c"], [0, 0, 3]), (["a b c"], [0])]
    pair = made[1][0]
    assert pair[1] == pair[2] != pair[0] and int(max(k for keys, *_ in made for k in keys)) < 1 << sift.BITS


def test_oneshot_makes_no_string_of_rare_ngrams(spark, tmp_path):
    from topicscope.plans.study import Study
    docs = [(i, "en", f"s{i % 2}", "alpha beta gamma " + f"rare{'x' * i}", 10) for i in range(12)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    s = Study(spark, str(tmp_path), ngram=(1, 3), least=2, most=None)
    assert {r.term for r in s.packed.uses.collect()} == {"alpha", "beta", "gamma", "alpha_beta", "beta_gamma", "alpha_beta_gamma"}
    assert all(np.isclose(r.weight, 6 / 12 * 1 / 6) for r in s.theta.collect()) and len(s.theta.collect()) == 24


def test_ngrams_of_few_classes(spark, tmp_path):
    """As counted from all n-grams, a missing class being one; no string is made of those that too few classes have."""
    from topicscope.operators import ctfidf, terms
    docs = spark.createDataFrame([(i, c, t) for i, c, t in DOCS] + [(7, "c", "x y q q q"), (8, "c", "q x y"), (9, "d", "y z")], "doc_id bigint, source string, text string")
    spec = terms.DtmSpec(ngram=(1, 3), sep=" ")
    full = ctfidf.class_term_counts(docs, spec, "source")
    want = sorted(ctfidf.min_class_freq(full, 3).collect())
    got = ctfidf.class_term_counts_from(docs, spec, "source", 3)
    assert sorted(ctfidf.min_class_freq(got, 3).collect()) == want and want
    assert {r.term for r in got.collect()} == {r.term for r in want}
    assert got.count() < full.count()
