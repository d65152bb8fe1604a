from pyspark.sql import functions as F

from topicscope.operators import vocab

# vocab10: a tie at ranks 3/4 (c, d both 7)
VOCAB10 = [("a", 10), ("b", 9), ("d", 7), ("c", 7), ("e", 5), ("f", 4), ("g", 3), ("h", 2), ("i", 1), ("j", 1)]


def totals(spark, rows=VOCAB10):
    return spark.createDataFrame(rows, "term string, tf bigint")


def test_rank_ties_by_term(spark):
    r = {x.term: x.rank for x in vocab.rank_terms(totals(spark)).collect()}
    assert [t for t, _ in sorted(r.items(), key=lambda kv: kv[1])] == list("abcdefghij")


def test_rank_matches_global_sort_large(spark):
    rows = [(f"t{i:05d}", (i * 7919) % 97) for i in range(3000)]
    r = vocab.rank_terms(totals(spark, rows)).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    got = sorted(r, key=lambda x: x.rank)
    assert [x.term for x in got] == [w[0] for w in want]
    assert all(x.vocab_size == 3000 for x in got)


def test_rank_spreads_one_frequency(spark):
    """All terms once, one prefix: the rows of the one tf lie in many parts and still have one order."""
    from topicscope.functions import ranks
    rows = spark.range(40_000).select(F.format_string("aa%06d", "id").alias("term"), F.lit(1).cast("bigint").alias("tf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # such a small table would be one part
    try:
        placed = ranks.placed(rows, F.desc("tf"), F.asc("term"), name="t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks_ok = placed.join(F.broadcast(ranks.offsets(placed)), "_part").agg(
        F.count_if(F.format_string("aa%06d", F.col("_offset") + F.col("_row")) == F.col("term"))).first()[0]
    assert ranks_ok == 40_000
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000
    got = vocab.rank_terms(rows).agg(F.count_if(F.format_string("aa%06d", F.col("rank") - 1) == F.col("term")), F.max("vocab_size")).first()
    assert tuple(got) == (40_000, 40_000)
    assert vocab.rank_terms(rows.limit(0)).count() == 0


def removed(spark, n, kind, mode, compat=True):
    r = vocab.rank_terms(totals(spark))
    return sorted(x.term for x in vocab.removal_terms(r, n, kind, mode, compat).collect())


def test_removal_counts_compat(spark):
    assert removed(spark, 1, "most", "absolute") == ["a"]
    assert removed(spark, 3, "most", "absolute") == ["a", "b"]          # n - 1
    assert removed(spark, 2, "least", "absolute") == ["i", "j"]         # n
    assert removed(spark, 0.2, "most", "percent") == ["a", "b"]         # round(10 * .2)
    assert removed(spark, 0.01, "most", "percent") == ["a"]             # at least 1
    assert removed(spark, 0.2, "least", "percent") == ["h", "i", "j"]   # round(N p) + 1


def test_removal_counts_exact(spark):
    assert removed(spark, 3, "most", "absolute", compat=False) == ["a", "b", "c"]
    assert removed(spark, 0.2, "least", "percent", compat=False) == ["i", "j"]


def test_removal_frequency(spark):
    r = vocab.rank_terms(totals(spark))
    assert [x.removal_frequency for x in vocab.removal_frequency(r, 0.2, "most").collect()] == [9]
    assert [x.removal_frequency for x in vocab.removal_frequency(r, 0.2, "least").collect()] == [2]


def test_threshold_and_quantile(spark):
    t = totals(spark)
    assert sorted(x.term for x in vocab.keep_by_threshold(t, 3, 9).collect()) == list("cdef")
    assert sorted(x.term for x in vocab.keep_by_threshold(t, None, 3).collect()) == list("hij")
    kept = {x.term for x in vocab.keep_by_quantile(t, 0.05, 0.95).collect()}
    assert kept == set("bcdefgh")


def test_occurrence(spark):
    t = totals(spark)
    kept = {x.term for x in vocab.keep_by_occurrence(t, F.lit(50), 0.1).collect()}  # tf > round(5) - 1
    assert kept == set("abcde")


def test_trim_and_split_do_not_sort_document_term_rows(spark, tmpdir_path):
    """The vocabulary and the ids are the hashed sides: the document-term rows are never sorted for a join."""
    dtm = spark.createDataFrame([(d, t, 1) for d in range(6) for t in ("a", "b", "c", None)] + [(None, "a", 2), (1, "a", 5)], "doc_id bigint, term string, n bigint")
    kept = spark.createDataFrame([("a", 9), ("a", 9), ("c", 1), (None, 3)], "term string, tf bigint")
    got = vocab.restrict(dtm, kept)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.term, r.n) for r in got.collect()) == sorted(
        [(False, d, t, 1) for d in range(6) for t in ("a", "c")] + [(True, 0, "a", 2), (False, 1, "a", 5)])
    from topicscope.plans.registry import QUERIES
    from topicscope.plans import catalog  # noqa: F401
    docs = [(i % 40, f"alpha beta w{i % 3} w{i % 7} t{i}", "s", 10, "en") for i in range(50)] + [(None, "alpha beta", "s", 10, "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_chars bigint, lang string").write.parquet(f"{tmpdir_path}/documents.parquet")
    plan = QUERIES["dtm_test_split"](spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in plan
