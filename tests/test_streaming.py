import os

from pyspark.sql import functions as F

from topicscope.operators import lda, terms
from topicscope.streaming import scoring

SF = "/root/testdata/sf0.001"


def test_stream_scoring_equals_batch(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    spec = terms.DtmSpec()
    fitted = lda.fit(terms.dtm_long(docs, spec), lda.LdaConfig(k=3, max_iter=5), docs)
    src = os.path.join(tmpdir_path, "incoming")
    docs.repartition(3).write.parquet(src)
    stream = scoring.stream_documents(spark, src, docs.schema, max_files_per_trigger=1)
    out = os.path.join(tmpdir_path, "scored")
    name = "score_test_" + os.path.basename(tmpdir_path).replace("-", "_")   # fresh checkpoint per run
    q = scoring.start_scoring(stream, fitted, spec, out, name)
    q.awaitTermination(120)
    got = {(r.doc_id, r.topic): r.weight for r in spark.read.parquet(out).collect()}
    want = {(r.doc_id, r.topic): r.weight for r in fitted.theta().collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
