import os

from pyspark.sql import functions as F

from topicscope.sources import sinks

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 'multi\nline, "quoted"'), (2, "plain")], "id int, text string")
    p = os.path.join(tmpdir_path, "csv")
    sinks.write_csv(df, p)
    back = sinks.read_csv(spark, p, "id int, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_topic_terms_files(spark, tmpdir_path):
    top = spark.createDataFrame([(-1, 1, "x", 0.5), (0, 1, "a", 0.9), (0, 2, "b", 0.1), (1, 1, "c", 1.0)],
                                "topic int, rank int, term string, score double")
    p = os.path.join(tmpdir_path, "terms")
    sinks.write_topic_terms(sinks.topic_terms_files(top), p)
    back = sinks.read_topic_terms(spark, p, 2)
    assert sorted((r.file_index, r.Word) for r in back.collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_stage_save_load(spark, tmpdir_path):
    df = spark.range(5)
    sinks.save_stage(df, tmpdir_path, 1234, "preds")
    assert sinks.load_stage(spark, tmpdir_path, 1234, "preds").count() == 5


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert {"pair", "topic", "p_value", "p_adjusted"} <= set(out.columns) and out.count() == 20
    assert set(E.oracle_sql()) <= set(E.queries())
    from topicscope.plans.registry import QUERIES
    assert set(QUERIES) <= set(E.queries())
    for name in QUERIES:
        assert not name.startswith("op") and "pipeline" not in name
