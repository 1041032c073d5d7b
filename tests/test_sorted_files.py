"""Sorted files, the rank index over them and how much a keyed batch opens."""

import random

import pytest
from pyspark.sql import functions as F

from dwellframe.operators.ranked import RankIndex
from dwellframe.sources.sorted_files import open_files, write_sorted
from dwellframe.streaming.listing_log import ListingLog

COLS = "key string, total_price double, unit_price double, status string, first_seen timestamp_ntz, last_updated timestamp_ntz"


def _rows(spark, n):
    return spark.range(n).select(F.format_string("k%06d", "id").alias("key"), F.col("id").cast("double").alias("total_price"),
                                 F.lit(1.0).alias("unit_price"), F.lit("on_sale").alias("status"),
                                 *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_updated")])


def test_manifest_tells_ranges_and_rows_ahead(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v"))
    write_sorted(df, f"{tmp_path}/rows", f"{tmp_path}/files", "k", 64)
    files = spark.read.parquet(f"{tmp_path}/files").orderBy("low").collect()
    assert sum(f["rows"] for f in files) == 1000 and max(f["rows"] for f in files) <= 64
    ahead = 0
    for f in files:
        assert (f["start"], f["low"], f["high"]) == (ahead, ahead, ahead + f["rows"] - 1)
        ahead += f["rows"]
        assert open_files(spark, f"{tmp_path}/rows", [f["file"]]).agg(F.min("k")).first()[0] == f["low"]
    assert open_files(spark, f"{tmp_path}/rows", []).count() == 0


@pytest.mark.parametrize("n", [0, 1, 20, 997])
def test_every_page_of_the_index(spark, tmp_path, n):
    names = [f"n{i:05d}" for i in range(n)]
    random.Random(3).shuffle(names)
    df = spark.createDataFrame([(x, len(x)) for x in names], "name string, size int")
    index = RankIndex.build(df, str(tmp_path / "index"), "name", rows_per_file=50)
    assert index.count() == n
    for no in {1, 2, 3, n // 20, n // 20 + 1, n // 20 + 5} - {0}:
        got = [r["name"] for r in index.page(no, 20).collect()]
        assert got == sorted(names)[(no - 1) * 20:no * 20]
    with pytest.raises(ValueError):
        index.page(0, 20)


def test_a_deep_page_opens_as_few_files_as_the_first(spark, tmp_path):
    index = RankIndex.build(spark.range(5000), str(tmp_path / "index"), "id", rows_per_file=100)
    assert len(spark.read.parquet(f"{tmp_path}/index/rows").inputFiles()) >= 50
    opened = [len(index.page(no, 20).inputFiles()) for no in (1, 100, 250)]
    assert max(opened) <= 2


def test_what_a_batch_opens_follows_its_keys_at_ten_times_the_base(spark, tmp_path):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    opened = {}
    for n in (2000, 20000):
        log = ListingLog(spark, str(tmp_path / f"log{n}"), "key", rows_per_file=100)
        log.load(_rows(spark, n))
        keys = spark.createDataFrame([(f"k{i:06d}",) for i in (5, 700, 1999, 999999)], "key string")
        found = log.current(keys)
        assert {r["key"]: r["total_price"] for r in found.collect()} == {"k000005": 5.0, "k000700": 700.0, "k001999": 1999.0}
        opened[n] = len(found.inputFiles())
        log.apply(keys.withColumns({"total_price": F.lit(9.5), "unit_price": F.lit(1.0), "no": F.lit(1)}), 0, now, "no")
        assert log.current().count() == n + 1 and log.current(keys).agg(F.min("total_price")).first()[0] == 9.5
        assert len(log.current(keys).inputFiles()) <= opened[n] + 1
    assert 1 <= opened[2000] <= 4 and 1 <= opened[20000] <= 4


def test_a_log_may_start_empty_and_a_compacted_batch_may_be_repeated(spark, tmp_path):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    log = ListingLog(spark, str(tmp_path / "log"), "key", compact_every=1)
    log.load(spark.createDataFrame([], COLS))
    assert log.current().count() == 0
    batch = _rows(spark, 30).drop("status", "first_seen", "last_updated").withColumn("no", F.lit(1))
    for n in (0, 1, 1, 2, 2):
        log.apply(batch.withColumn("total_price", F.lit(100.0 + n)), n, now, "no")
    assert log.current().groupBy("total_price").count().collect()[0] == (102.0, 30)
