"""LDA and invariants: planted-topic recovery, partition invariance, sums."""
import random

import pytest
from pyspark.sql import functions as F

from topicscope.operators import lda, terms, topics

VOCABS = [["apple", "banana", "cherry", "grape", "lemon", "mango", "peach", "plum"],
          ["engine", "wheel", "brake", "clutch", "piston", "gear", "tyre", "axle"],
          ["violin", "cello", "flute", "oboe", "harp", "drum", "tuba", "piano"]]


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(3)
    rows = []
    for t, words in enumerate(VOCABS):
        for j in range(60):
            rows.append((t * 60 + j, " ".join(rnd.choice(words) for _ in range(30)), t))
    return spark.createDataFrame(rows, "doc_id bigint, text string, true_topic int")


def fit(planted, parts):
    spec = terms.DtmSpec()
    docs = planted.repartition(parts)
    dtm = terms.dtm_long(docs, spec)
    return lda.fit(dtm, lda.LdaConfig(k=3, max_iter=10, seed=11), docs)


def test_recovery_and_sums(spark, planted):
    m = fit(planted, 4)
    theta = m.theta()
    best = (theta.withColumn("r", F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("doc_id").orderBy(F.desc("weight"))))
        .where("r = 1").join(planted, "doc_id"))
    pairs = best.groupBy("true_topic", "topic").count().collect()
    # majority mapping true -> found topic must cover >= 90 % of documents
    hit = sum(max(r["count"] for r in pairs if r.true_topic == t) for t in range(3))
    assert hit >= 0.9 * 180
    sums = theta.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in sums)
    phis = m.phi().groupBy("topic").agg(F.sum("phi").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in phis)
    prev = topics.prevalence(theta).agg(F.sum("prevalence")).collect()[0][0]
    assert prev == pytest.approx(100)
    g = topics.topic_given_word(m.phi(), theta).groupBy("term").agg(F.sum("gamma").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in g)


def test_partition_invariance(spark, planted):
    a = {(r.topic, r.term): r.phi for r in fit(planted, 1).phi().collect()}
    b = {(r.topic, r.term): r.phi for r in fit(planted, 7).phi().collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_empty_document_gets_prior(spark, planted):
    m = fit(planted, 2)
    extra = spark.createDataFrame([(999, "zzz unknown words")], "doc_id bigint, text string")
    w = {r.topic: r.weight for r in m.theta(terms.dtm_long(extra, terms.DtmSpec()), extra).collect()}
    assert w == pytest.approx({t + 1: a / m.alpha.sum() for t, a in enumerate(m.alpha)})


def brute_round(dtm, phi, alpha, rounds, k):
    """theta and expected counts of plain loops over (doc, term, n)."""
    docs = {}
    for d, w, n in dtm:
        docs.setdefault(d, []).append((w, n))
    counts, thetas = {w: [0.0] * k for w in phi}, {}
    for d, rows in docs.items():
        theta, size = [1 / k] * k, sum(n for w, n in rows if w in phi)
        for turn in range(rounds + 1):
            m = [0.0] * k
            for w, n in rows:
                if w in phi:
                    total = sum(t * p for t, p in zip(theta, phi[w]))
                    for t in range(k):
                        r = n * theta[t] * phi[w][t] / total
                        m[t] += r
                        if turn == rounds:
                            counts[w][t] += r
            if turn < rounds:
                theta = [(x + a) / (size + sum(alpha)) for x, a in zip(m, alpha)]
        thetas[d] = theta
    return thetas, counts


def test_rounds_equal_brute_force(spark):
    """One fit round and a fold-in, over several blocks, against plain loops; unknown terms are left out."""
    rnd = random.Random(5)
    rows = sorted({(d, f"w{rnd.randint(0, 40)}"): rnd.randint(1, 4) for d in range(50) for _ in range(12)}.items())
    dtm = [(d, w, n) for (d, w), n in rows]
    frame = spark.createDataFrame(dtm, "doc_id bigint, term string, n bigint").repartition(5)
    cfg = lda.LdaConfig(k=3, max_iter=1, optimize_alpha=False, doc_rounds=4, block_cells=200)
    start = {r.term: r.c for r in lda.start_counts(frame, 3, cfg.seed).collect()}
    totals = [sum(c[t] for c in start.values()) for t in range(3)]
    phi = {w: [(x + cfg.beta) / (totals[t] + len(start) * cfg.beta) for t, x in enumerate(c)] for w, c in start.items()}
    theta, counts = brute_round(dtm, phi, [0.1] * 3, 4, 3)
    m = lda.fit(frame, cfg)
    assert m.blocks.n > 5
    got = {r.term: r.c for r in m.counts.collect()}
    assert got.keys() == counts.keys() and all(got[w] == pytest.approx(counts[w]) for w in got)
    some = {w: p for w, p in phi.items() if w != "w7" and w != "w8"}
    table = spark.createDataFrame([(t, w, p[t]) for w, p in some.items() for t in range(3)], "topic int, term string, phi double")
    extra = spark.createDataFrame([(d,) for d in range(51)], "doc_id bigint")
    theta, _ = brute_round(dtm, some, [0.1] * 3, 6, 3)
    theta[50] = [1 / 3] * 3
    got = {(r.doc_id, r.topic): r.weight for r in lda.fold_in(frame, table, 0.1, 6, extra, block_cells=300).collect()}
    assert len(got) == 153 and all(got[d, t] == pytest.approx(theta[d][t]) for d in theta for t in range(3))


def test_digamma():
    assert lda.digamma(__import__("numpy").array([0.01, 0.5, 1.0, 10.0])) == pytest.approx([-100.56088545786868, -1.9635100260214235, -0.5772156649015329, 2.251752589066721])


def test_alpha_follows_the_documents(spark, planted):
    """Documents of one topic each pull alpha down; likelihood rises with the rounds."""
    dtm = terms.dtm_long(planted, terms.DtmSpec())
    short, long = (lda.fit(dtm, lda.LdaConfig(k=3, max_iter=i, seed=11), planted) for i in (2, 10))
    assert long.alpha.sum() < short.alpha.sum()
    a, b = short.quality().first(), long.quality().first()
    assert a.log_likelihood < b.log_likelihood < 0 and b.log_perplexity == pytest.approx(-b.log_likelihood / (180 * 30))


def test_empty_table(spark):
    m = lda.fit(spark.createDataFrame([], "doc_id bigint, term string, n bigint"), lda.LdaConfig(k=2, max_iter=2))
    assert m.phi().count() == 0 and m.theta().count() == 0 and m.quality().first().log_likelihood == 0


def test_saved_model_scores_alike(spark, planted, tmpdir_path):
    m = fit(planted, 3)
    m.save(tmpdir_path)
    dtm = terms.dtm_long(planted, terms.DtmSpec())
    a, b = ({(r.doc_id, r.topic): r.weight for r in x.theta(dtm, planted).collect()} for x in (m, lda.load(spark, tmpdir_path)))
    assert a == pytest.approx(b) and len(a) == 540


def test_kept_blocks_move_only_terms(spark):
    """Documents are dealt out by block once: a fit's rounds do not shuffle or sort them again, and wide documents agree with plain loops."""
    from topicscope.operators import blocks as B
    dtm = [(d, f"w{i}", 1 + (d + i) % 3) for d, size in enumerate((1, 3, 700, 2100, 40, 41, 1030)) for i in range(size)]
    frame = spark.createDataFrame(dtm, "doc_id bigint, term string, n bigint")
    m = lda.fit(frame, lda.LdaConfig(k=3, max_iter=1, optimize_alpha=False, doc_rounds=3, block_cells=6000))
    start = {r.term: r.c for r in lda.start_counts(frame, 3, 1234).collect()}
    totals = [sum(c[t] for c in start.values()) for t in range(3)]
    phi = {w: [(x + 0.05) / (totals[t] + len(start) * 0.05) for t, x in enumerate(c)] for w, c in start.items()}
    _, counts = brute_round(dtm, phi, [0.1] * 3, 3, 3)
    got = {r.term: r.c for r in m.counts.collect()}
    assert got.keys() == counts.keys() and all(got[w] == pytest.approx(counts[w]) for w in got)
    plan = B.each_kept_block(m.blocks, m.counts, lambda held: None, "term string, c array<double>")._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("FlatMapCoGroups"):]
    docs = above[:above.index("InMemoryTableScan")]
    assert "Exchange" not in docs


def test_round_moves_a_row_for_each_part_and_block(spark, monkeypatch):
    from topicscope.operators import blocks as B
    monkeypatch.setattr(lda, "PART_CELLS", 400)
    dtm = [(d, f"w{(d * 7 + j * j) % 90}", 1 + j % 3) for d in range(60) for j in range(12)]
    frame = spark.createDataFrame(dtm, "doc_id bigint, term string, n bigint").groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
    blocks = B.block_pairs(frame, 3, 600).keep()
    counts = lda.start_counts(frame, 3, 5)
    parts, state = lda.deal_terms(blocks, counts, 3)
    sent = parts.send(state).collect()
    assert parts.n > 1 and blocks.n > 1 and len(sent) <= parts.n * blocks.n < blocks.uses.count()
    assert sum(len(r.pos) for r in sent) == 4 * blocks.uses.count()
    want = {r.term: list(r.c) for r in counts.collect()}
    assert {r.term: list(r.c) for r in parts.table(state).collect()} == want
    # every block and part has a partition of its own
    for n in (1, 7, 48):
        keys = spark.createDataFrame([(x,) for x in B.even_labels(spark, n)], "k int")
        assert keys.select(F.pmod(F.hash("k"), F.lit(n))).distinct().count() == n
