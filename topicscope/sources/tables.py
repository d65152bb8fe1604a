"""Scans: driver parquet tables and user CSV corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("documents", "labels", "embeddings", "conversations", "events")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None, always: bool = False) -> DataFrame:
    """Give a scan enough parallelism for the per-row text work that follows.

    A large input already arrives in many file splits and is left alone.  A
    scan with fewer splits than the cluster has cores (one big row group) is
    spread on ``key`` (round-robin without one).  Spreading documents on their
    id lets the per-document term aggregate (``groupBy(doc_id, ..., term)``)
    run without a shuffle: the raw text moves once instead of the n-gram table,
    which is several times larger; with ``always`` a large input is dealt out by the
    key too.  Only planning happens here, no job.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df.repartition(4 * have, key) if always else df
    return df.repartition(want, key) if key else df.repartition(want)


#: Bytes of input that a task counts in one go.
GATHERED = 24 << 20


def gathered(df: DataFrame) -> DataFrame:
    """Fewer, larger partitions of a large spread input, one after another in a task: what is kept a partition is kept for more documents."""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    have = df.rdd.getNumPartitions()
    want = max(2 * spark.sparkContext.defaultParallelism, -(-(have // 4) * split // GATHERED))     # ``spread`` makes four of a split
    return df.coalesce(want) if want < have else df


def corpus_schema(id_col: str, text_col: str, extra: dict[str, T.DataType] | None = None) -> T.StructType:
    fields = [T.StructField(id_col, T.StringType()), T.StructField(text_col, T.StringType())]
    for name, dt in (extra or {}).items():
        fields.append(T.StructField(name, dt))
    return T.StructType(fields)


def scan_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read a corpus table.  CSV: header row, quoted multi-line fields, an
    explicit schema when given (inference needs an extra pass over the data)."""
    if fmt == "csv":
        reader = (spark.read.option("header", True).option("multiLine", True)
                  .option("quote", '"').option("escape", '"'))
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """The ``documents`` corpus, optionally one language, spread on doc_id."""
    df = read_table(spark, sf_dir, "documents")
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    return spread(df, "doc_id")
