"""Sinks and exports (S2-S6, S9, S10): CSV/parquet writers and wide views.

Writers are single distributed writes (``partitionBy`` instead of a loop of
files).  Wide views pivot over a bounded list of topic ids (k values).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def _topics(df: DataFrame, col: str = "topic") -> list:
    # k distinct topic ids: bounded by the number of topics, not by the data
    return sorted(r[0] for r in df.select(col).distinct().collect())


def theta_wide(theta: DataFrame, topic_list=None, id_col: str = "doc_id", base: int = 1, digits: int = 6, name: str = "t_{}") -> DataFrame:
    """One row per document, columns t_1..t_k (topics in sorted order); the key is kept.

    ``name`` gives the columns other names, for example ``Dim{}_texts``.  Without a list of topics a job finds them.
    """
    topics = topic_list if isinstance(topic_list, (list, tuple)) else _topics(theta)
    names = {t: name.format(i + base) for i, t in enumerate(topics)}
    mapping = F.create_map(*[x for t in topics for x in (F.lit(t), F.lit(names[t]))])
    return (theta.select(id_col, mapping[F.col("topic")].alias("_t"), F.round("weight", digits).alias("w"))
            .groupBy(id_col).pivot("_t", [names[t] for t in topics]).agg(F.first("w")))


def topic_terms_files(top: DataFrame, score: str = "score", outlier=-1) -> DataFrame:
    """(file_index, Word, phi): file i+1 for topic i, the outlier topic -> file 0."""
    idx = F.when(F.col("topic") == outlier, F.lit(0)).otherwise(F.col("topic") + 1)
    return top.select(idx.alias("file_index"), F.col("term").alias("Word"), F.col(score).alias("phi"), "rank")


def write_topic_terms(files: DataFrame, path: str) -> None:
    """All per-topic term files in one write: <path>/file_index=<i>/part-*.csv."""
    (files.repartition("file_index").sortWithinPartitions("rank").drop("rank")
     .write.mode("overwrite").option("header", True).partitionBy("file_index").csv(path))


def read_topic_terms(spark: SparkSession, path: str, num_topics: int) -> DataFrame:
    """Files 1..k back as one table (partition discovery, outlier file 0 skipped)."""
    return read_csv(spark, path).where((F.col("file_index") >= 1) & (F.col("file_index") <= num_topics))


def topic_dictionary_wide(top: DataFrame, score: str = "score") -> DataFrame:
    """One row per rank, one column per topic; cells "('term', score)"."""
    topics = _topics(top)
    cell = F.format_string("('%s', %.6f)", F.col("term"), F.col(score))
    return top.groupBy("rank").pivot("topic", topics).agg(F.first(cell))


def stage_path(folder: str, seed: int, stage: str) -> str:
    return f"{folder.rstrip('/')}/seed_{seed}/{stage}"


def signature(df: DataFrame) -> str:
    """Number and combined hash of the rows, whatever their order: tells one input from another."""
    n, bits = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
    return f"{n}:{bits & 0xFFFFFFFFFFFFFFFF:016x}"


def save_stage(df: DataFrame, save_dir: str, seed: int, stage: str, mode: str = "overwrite", params: dict | None = None) -> str:
    """Write a pipeline stage as parquet under <save_dir>/seed_<seed>/<stage>, with a manifest of its parameters and schema.

    The manifest is written last, so a stage that was not finished has none.
    """
    path = stage_path(save_dir, seed, stage)
    df.write.mode(mode).parquet(f"{path}/rows")
    manifest = {"params": params or {}, "schema": df.schema.simpleString()}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def load_stage(spark: SparkSession, load_dir: str, seed: int, stage: str, params: dict | None = None) -> DataFrame:
    """A saved stage; with ``params`` only if it was saved with just these (ValueError names what differs)."""
    path = stage_path(load_dir, seed, stage)
    saved = json.loads(spark.read.schema("manifest string").json(f"{path}/manifest").first().manifest)
    rows = spark.read.parquet(f"{path}/rows")
    if params is not None:
        want = json.loads(json.dumps(params, default=str))
        differ = sorted(k for k in want.keys() | saved["params"].keys() if want.get(k) != saved["params"].get(k))
        if differ:
            raise ValueError(f"stage {stage} was saved with other parameters: " + ", ".join(f"{k} = {saved['params'].get(k)!r}, not {want.get(k)!r}" for k in differ))
    if rows.schema.simpleString() != saved["schema"]:
        raise ValueError(f"stage {stage} has the schema {rows.schema.simpleString()}, its manifest {saved['schema']}")
    return rows
