"""What large tables leave on disk: shuffles and tables that are used up go, packed documents take few bytes."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicscope import staging
from topicscope.operators import blocks as B
from topicscope.operators import lda, terms


def states(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{staging.run_folder(spark)}/lda-state-*")
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def shuffle_files(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") and f.endswith(".data") for d in top for _, _, names in os.walk(d.getPath()) for f in names)


def test_a_staged_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    table = staging.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count(), "few")
    assert table.count() == 7 and spark.conf.get(staging.CLEANUP, None) is None
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffle_files(spark) <= before + 1      # of the count above, at most
    staging.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(*table.inputFiles())


def test_numbers_in_few_bytes():
    x = np.array([0, 255, 256, 1, 65536, 3, 1 << 24, 7], "i8")
    cuts = [0, 2, 4, 6, 8]
    got = B.shortened(x, cuts)
    assert [len(g) for g in got] == [3, 5, 7, 9]
    assert [B.lengthened(g).tolist() for g in got] == [x[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    assert B.lengthened(b"").tolist() == [] and B.shortened(x[:0], [0]) == []


def test_packed_documents_are_short_and_the_last_counts_alone_stay(spark):
    docs = spark.createDataFrame([(i, "a", " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(40))) for i in range(30)], "doc_id bigint, topic string, text string")
    rows = terms.kept_arrays(docs.repartition(2, "doc_id").sortWithinPartitions("doc_id", "topic"), terms.DtmSpec(), ("topic",)).withColumnRenamed("doc_id", "id")
    blocks = B.block_terms(rows)
    assert blocks.short and all(len(r.idx) == len(r.n) <= 27 for r in blocks.docs.collect())
    held = B.held_pairs(blocks, blocks.uses)
    before = len(states(spark))
    m = lda.fit(None, lda.LdaConfig(k=2, max_iter=4), blocks=blocks, totals=held.groupBy("term").agg(F.sum("n").alias("tf")))
    assert m.theta().count() == 60
    assert len(states(spark)) == before + 1        # of four rounds
    want = lda.fit(held.withColumnRenamed("id", "doc_id"), lda.LdaConfig(k=2, max_iter=4))
    a, b = ({(r.doc_id, r.topic): r.weight for r in x.theta().collect()} for x in (m, want))
    assert a.keys() == b.keys() and all(np.isclose(a[x], b[x], atol=1e-9) for x in a)
