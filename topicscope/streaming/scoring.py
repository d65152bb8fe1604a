"""Frozen-model scoring of arriving documents with Structured Streaming (I4).

Each micro-batch is turned into a document-term table and folded in against the
fitted topics with the batch operators; documents are scored one by one, so no
watermark or state store is needed.  A batch writes a folder of its own by its
number (a repeated batch overwrites it), and progress is kept in a checkpoint
location under the shared checkpoint folder, so a restarted query resumes where
it stopped and no document is scored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from topicscope.operators import lda, terms
from topicscope.session import checkpoint_dir


def stream_documents(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score(docs: DataFrame, fitted: lda.FittedLda, spec: terms.DtmSpec) -> DataFrame:
    """(doc_id, topic, weight) of a batch of documents."""
    return fitted.theta(terms.dtm_long(docs, spec), docs)


def start_scoring(docs: DataFrame, fitted: lda.FittedLda, spec: terms.DtmSpec, out_path: str, name: str,
                  available_now: bool = True):
    """Start the scoring query writing parquet to ``out_path``/batch=<n>; returns the StreamingQuery."""
    ckpt = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/streams/{name}"

    def write(batch: DataFrame, number: int) -> None:
        score(batch, fitted, spec).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={number}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
