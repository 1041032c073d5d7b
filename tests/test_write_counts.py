"""Counts that a write observes of itself."""

from pyspark.sql import functions as F

from dwellframe.sources import tables

COLS = "id int, status string, price double"


def test_counts_follow_values(spark, tmp_path):
    rows = [(1, "on", 5.0), (2, None, 5.0), (3, "on", None), (3, "on", None), (4, "off", 1.0)]
    df = spark.createDataFrame(rows, COLS)
    path = [str(tmp_path / f"v{i}") for i in range(4)]
    assert tables.insert(df, path[0]) == tables.WriteCount(5, 5)
    read = spark.read.parquet(path[0])
    # A condition that is null does not hold; a value that stays the same is no change.
    done = tables.update(read, path[1], {"status": F.lit("off"), "price": F.col("price") + 1}, F.col("price") < 6)
    assert done == tables.WriteCount(5, 3)
    assert sorted(map(tuple, spark.read.parquet(path[1]).collect()), key=str) == sorted(
        [(1, "off", 6.0), (2, "off", 6.0), (3, "on", None), (3, "on", None), (4, "off", 2.0)], key=str)
    assert tables.update(read, path[2], {"status": F.lit("on")}, F.col("status") == "on") == tables.WriteCount(5, 0)
    assert tables.delete(read, path[3], F.col("price") >= 5) == tables.WriteCount(3, 2)
    assert sorted(r.id for r in spark.read.parquet(path[3]).collect()) == [3, 3, 4]


def test_nothing_to_write(spark, tmp_path):
    empty = spark.createDataFrame([], COLS)
    none = tables.WriteCount(0, 0)
    assert tables.insert(empty, str(tmp_path / "a")) == none
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert tables.update(stored, str(tmp_path / "b"), {"status": F.lit("x")}, F.lit(True)) == none
    assert tables.delete(stored, str(tmp_path / "c"), F.lit(True)) == none
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["id", "status", "price"]
