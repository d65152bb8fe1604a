"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.session import checkpoint_dir

#: ASCII upper and lower case, for ``translate`` (other letters stay as they are).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def in_slices(col, rows: int = 256):
    """The values of an Arrow array, turned into Python ones a slice at a time: a worker never holds a whole batch of them."""
    for i in range(0, len(col), rows):
        yield from col.slice(i, rows).to_pylist()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running tasks only.  The table
    stays until the folder is cleaned.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of labels that a classifier is fitted on at most (about: the choice is by hash).
LABEL_BOUND = 1 << 17


def labelled_sample(labels: DataFrame, id_col: str, bound: int = LABEL_BOUND):
    """Labelled rows for a fit, collected: all of them, or beyond ``bound`` rows a share chosen by a hash of the id.

    Rows without an id are left out.  The result is small by ``bound`` and may be broadcast.
    """
    rows = labels.where(F.col(id_col).isNotNull())
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    return rows.toArrow()


def held_out(id_col: str, modulus: int):
    """crc32 of the id's decimal text is 0 modulo ``modulus`` (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(False))
