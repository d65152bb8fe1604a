"""Window similarities (approximate distribution, token level) against plain loops."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from topicscope.operators import ctfidf

SCHEMA = "doc_id bigint, text string"


def brute(docs, scores, idf, window, least):
    """{doc: {topic: weight}} and {(doc, pos, topic): weight} by the rule's words."""
    norm = defaultdict(float)
    for (t, _), s in scores.items():
        norm[t] += s * s
    doc_level, token_level = {}, Counter()
    for d, text in docs:
        toks = [w for w in (text or "").split() if len(w) >= 2]
        total = Counter()
        for i in range(max(len(toks) - window + 1, 1) if toks else 0):
            counts = Counter(w for w in toks[i:i + window] if w in idf)
            n = sum(counts.values())
            v = {w: c / n * idf[w] for w, c in counts.items()}
            vn = math.sqrt(sum(x * x for x in v.values()))
            for t in norm:
                sim = sum(x * scores.get((t, w), 0) for w, x in v.items()) / (vn * math.sqrt(norm[t])) if vn else 0
                if sim >= least:
                    total[t] += sim
                    for p in range(i, min(i + window, len(toks))):
                        token_level[d, p, t] += sim
        if total:
            doc_level[d] = {t: s / sum(total.values()) for t, s in total.items()}
    return doc_level, token_level


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    words = [f"w{c}" for c in "abcdefghijkl"]
    idf = {w: rng.uniform(0.2, 2) for w in words[:10]}                    # two words have no scores
    scores = {(t, w): rng.uniform(0, 1) for t in (-1, 0, 3) for w in words[:10] if rng.random() < 0.6}
    docs = [(i, " ".join(rng.choice(words + ["x"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 40])))) for i in range(60)] + [(99, None), (100, "wk wl wk")]
    return docs, {k: v for k, v in scores.items()}, {w: x for w, x in idf.items() if any(w == s for _, s in scores)}


def test_distributions_equal_brute_force(spark, case):
    docs, scores, idf = case
    doc_level, token_level = brute(docs, scores, idf, 4, 0.3)
    d = spark.createDataFrame(docs, SCHEMA)
    s = spark.createDataFrame([(t, w, x) for (t, w), x in scores.items()], "topic int, term string, score double")
    i = spark.createDataFrame(list(idf.items()), "term string, idf double")
    got = defaultdict(dict)
    for r in ctfidf.approx_distribution(d, s, i, 4, 0.3).collect():
        got[r.doc_id][r.topic] = r.weight
    assert got.keys() == doc_level.keys() and all(got[k] == pytest.approx(doc_level[k]) for k in got)
    rows = ctfidf.token_distribution(d, s, i, 4, 0.3).collect()
    assert {(r.doc_id, r.pos, r.topic): r.weight for r in rows} == pytest.approx(dict(token_level))
    toks = {k: [w for w in (t or "").split() if len(w) >= 2] for k, t in docs}
    assert all(toks[r.doc_id][r.pos] == r.token for r in rows)
    assert ctfidf.approx_distribution(d.limit(0), s, i).count() == 0


def test_long_documents_are_sliced(monkeypatch, case):
    """Slices of few positions give what one slice gives."""
    docs, scores, idf = case
    words = sorted(idf)
    labels = [-1, 0, 3]
    norms = np.array([math.sqrt(sum(x * x for (t, _), x in scores.items() if t == k)) for k in labels])
    rows = [(w, i, [idf[w], *[scores.get((t, w), 0.0) for t in labels]]) for i, w in enumerate(words)] + [("zz", len(words), None)]
    head = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["term", "at", "c"])
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, len(rows), n).astype("<i4") for n in (1, 3, 4, 5, 50)]
    b = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([s.tobytes() for s in seqs]), pa.array([b""] * 5)], names=["id", "idx", "n"])
    for by_token in (False, True):
        found = []
        for size in (1 << 15, 3, 1):
            monkeypatch.setattr(ctfidf, "SLICE", size)
            task = ctfidf.Windows([head], pa.array(labels, pa.int32()), norms, 4, 0.3, by_token)
            found.append({tuple(r[c] for c in ("id", "topic", "pos") if c in r): r["weight"] for out in task.docs(b) for r in out.to_pylist()})
        assert found[0] and found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])
