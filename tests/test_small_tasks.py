"""Shuffles whose parts grow in number with the rows."""

import pytest
from pyspark.sql import functions as F

from dwellframe import session
from dwellframe.plans import load_all


def test_parts_follow_the_rows(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.sized_parts(spark, 10) == usual
    assert session.sized_parts(spark, 100 * session.PART_ROWS + 1) == 101


def test_settings_are_put_back(spark):
    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.maxConcurrentOutputFileWriters"]
    before = [spark.conf.get(n, None) for n in names]
    with pytest.raises(KeyError), session.small_tasks(spark, 33):
        assert spark.conf.get(names[0]) == "33"
        raise KeyError
    assert [spark.conf.get(n, None) for n in names] == before


def test_watched_files_are_counted_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 300)
    rows = load_all()["stream_files"].build(spark, "/root/testdata/sf0.001")
    rows.collect()
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.agg(F.sum("rows")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
