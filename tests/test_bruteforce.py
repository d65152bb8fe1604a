"""Brute-force checks of the constructions that avoid per-pair work."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from topicscope.operators import ctfidf, terms, topics


@pytest.mark.parametrize("n_words,tops,m", [(12, ((0, 5), (4, 10)), 62), (130, ((0, 100), (60, 130)), 100)])
def test_coherence_matches_pairwise_formula(spark, n_words, tops, m):
    """Also beyond the bits of one mask word."""
    rnd = random.Random(9)
    words = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(n_words)]
    docs = [(d, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, n_words * 2 // 3)))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    dtm = terms.dtm_long(df, terms.DtmSpec(), )
    top_rows = [(t, r + 1, w) for t, (i, j) in enumerate(tops) for r, w in enumerate(words[i:j])]
    top = spark.createDataFrame(top_rows, "topic int, rank int, term string")
    got = {r.topic: r.coherence for r in topics.coherence(dtm, top, F.lit(40), m=m).collect()}
    sets = {d: set(t.split()) for d, t in docs}
    p = lambda *ws: sum(all(w in s for w in ws) for s in sets.values()) / 40
    for t in (0, 1):
        ws = [w for (tt, _, w) in sorted(top_rows) if tt == t]
        per_i = []
        for i in range(len(ws) - 1):
            vals = [p(ws[i], ws[j]) / p(ws[i]) - p(ws[j]) for j in range(i + 1, len(ws)) if p(ws[i]) > 0]
            if vals:
                per_i.append(sum(vals) / len(vals))
        assert got[t] == pytest.approx(sum(per_i) / len(per_i), abs=1e-12)
    with pytest.raises(Exception, match="rank is above m"):
        topics.coherence(dtm, top, F.lit(40), m=3).collect()


def test_hierarchy_equals_single_linkage(spark):
    rnd = random.Random(4)
    k = 9
    d = {(a, b): rnd.random() for a, b in itertools.combinations(range(k), 2)}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "topic_1 int, topic_2 int, distance double")
    got = {(r.topic_1, r.topic_2): r.merge_distance for r in ctfidf.topic_hierarchy(pairs).collect()}
    # Kruskal: merge height of a and b = weight of the edge that first connects them
    parent = list(range(k))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    height = {}
    members = {i: {i} for i in range(k)}
    for (a, b), w in sorted(d.items(), key=lambda kv: kv[1]):
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        for x in members[ra]:
            for y in members[rb]:
                height[(min(x, y), max(x, y))] = w
        parent[rb] = ra
        members[ra] |= members.pop(rb)
    assert got.keys() == height.keys()
    assert all(abs(got[p] - height[p]) < 1e-12 for p in got)
