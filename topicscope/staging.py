"""Written intermediate tables in the shared folder (``spark.checkpoint.dir``).

A staged table cuts the lineage: a lost executor costs the running tasks only.
All tables of a session lie in one run folder, which ``release`` removes; the
shuffles that a table was made by are removed when it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from topicscope.session import checkpoint_dir

_RUN = uuid.uuid4().hex


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/topicscope-{_RUN}"


#: Spark removes the shuffles of an action at its end, not when the driver happens to collect its garbage (before 4.1 it is not known and does nothing).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the actions within are removed at their end, those of persisted tables aside."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the run folder and read it back."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with own_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark, own = table.sparkSession, f"/topicscope-{_RUN}/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove this process's staged tables; frames that read them are no longer valid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
