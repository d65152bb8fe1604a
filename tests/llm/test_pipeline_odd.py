"""The pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import os

import corpus_pipeline

BASE = "the cat sat on the mat while a dog ran over green hills and many birds sang songs in tall old trees near my house today "


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))


def test_pipeline_on_odd_rows(spark, tmp_path):
    words = BASE.split()
    text = lambda i: " ".join(f"{w}{(i * 7 + k) % 97}" for k, w in enumerate(words * 4))
    long = " ".join(f"{w}{k}x{r}" for r in range(60) for k, w in enumerate(words))
    rows = [(i, long if i == 38 else text(i), f"s{i % 3}", "mine", i) for i in range(40)]
    rows += [(3, text(3), "s0", "mine", 3), (None, text(50), None, None, None), (None, text(50), None, None, None), (60, None, "s1", "x", 1), (61, "", "s1", "x", 1),
             (62, " \n ", None, "x", 1), (64, text(64) + " mail a.b@c.example now", "s1", "x", 1)]
    write(spark, str(tmp_path), rows, "doc_id bigint, text string, source string, n_entities string, pii_row int")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert None in ids and not ids & {60, 61, 62} and all(1 <= r.length <= 1024 for r in out)
    assert max(r.piece for r in out if r.doc_id == 38) > 0


def test_pipeline_on_no_rows(spark, tmp_path):
    write(spark, str(tmp_path), [], "doc_id bigint, text string, source string")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ngrams_of_a_batch_are_not_held_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from topicscope.llm import quality_llr
    text = " ".join(f"w{i}" for i in range(500))
    texts, counts = pa.array([text, None, ""] * 3000), np.zeros(1 << 12, "i8")
    tracemalloc.start()
    quality_llr.add_counts(counts, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 3000 * 999 and peak < 12 << 20     # 3000 * 999 numbers are 24 MB
    assert (counts == 3000 * np.bincount(quality_llr.ngram_bins(text, 1 << 12), minlength=1 << 12)).all()
