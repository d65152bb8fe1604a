"""Spark session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "topicscope", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (on a cluster, use the session the
    platform provides; nothing in the library depends on these settings)."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf["spark.driver.memory"] = "8g"   # local mode: the driver JVM is the executor
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A fallback is only applied when the session has none: an explicit one (tests),
    or, in local mode only, a fresh folder under /tmp.  On a cluster without the
    setting this raises instead of writing to a machine-local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None and spark.sparkContext.master.startswith("local"):
        import tempfile
        fallback = tempfile.mkdtemp(prefix="topicscope-ckpt-", dir="/tmp")
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    spark.conf.set("spark.checkpoint.dir", fallback)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback
