"""Token arrays numbered in blocks where they lie."""
import numpy as np
import pytest

from topicscope.operators import blocks as B
from topicscope.operators import ctfidf as C

ROWS = [(1, ["x", "y", "x"]), (1, ["z"]), (None, ["y"]), (2, []), (3, None), (4, ["x"] * 7)]


@pytest.mark.parametrize("cells", [1, 3, 1 << 20])
def test_sequences(spark, cells):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, toks array<string>").repartition(2)
    blocks = B.block_sequences(rows, "doc_id", "toks", 1, cells)
    words = {(r.block, r.idx): r.term for r in blocks.uses.collect()}
    got = [(r.id, [words[r.block, i] for i in np.frombuffer(r.idx, "<i4").tolist()]) for r in blocks.docs.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted([r for r in ROWS if r[1]], key=key)
    assert blocks.n == len({b for b, _ in words}) and (cells > 1 or blocks.n == 4)


def test_texts_do_not_move(spark):
    """No shuffle of the texts: neither for their classes nor for their blocks."""
    docs = spark.createDataFrame([(i, f"w{i} of x", f"s{i % 3}") for i in range(30)], "doc_id bigint, text string, source string")
    plan = C.class_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "text" in line]
