import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from topicscope.session import checkpoint_dir
    checkpoint_dir(s, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def tiny_corpus(spark):
    rows = [
        (1, "The cat sat on the mat. The cat!", "a", 1.0),
        (2, "", "a", 2.0),
        (3, "the and of", "b", 3.0),
        (4, "  leading blank then words", "b", None),
        (5, "trailing blanks   ", "a", 5.0),
        (6, "digits 123 and 4five mixed", "b", 6.0),
        (7, "Élan vital élan Vital dog dog", "a", 7.0),
        (8, "dog cat dog cat dog", "b", 8.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, grp string, y double")
