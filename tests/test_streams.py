"""Timers per key, snapshots of a running feed, and a folder of files with their own headers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellframe.schema import RAW_FIELDS_A, RAW_FIELDS_B
from dwellframe.sources.folder import watch_headed
from dwellframe.streaming import events as ev
from dwellframe.streaming.files import watch_feeds
from dwellframe.streaming.freshness import DAY, ROCKS, covered, status_changes
from dwellframe.streaming.sinks import drain_append
from dwellframe.streaming.snapshots import Snapshots

START = datetime(2024, 1, 1)
SCHEMA = (T.StructType().add("event_id", "long").add("ts", "timestamp_ntz").add("key", "string").add("ok", "boolean"))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.set(name, before)


def test_spans_merge_in_any_order():
    rng = random.Random(1)
    for _ in range(100):
        times = [rng.randint(0, 300) for _ in range(rng.randint(1, 40))]
        want, now = [], sorted(set(times))
        for t in now:
            if want and t - want[-1][1] <= 7:
                want[-1] = (want[-1][0], t)
            else:
                want.append((t, t))
        spans = []
        while times:
            part, times = times[:5], times[5:]
            spans = covered(np.array(part), 7, spans)
        assert spans == want


def changes_of(times, days, mark):
    """The changes of one key by its sorted confirmations, up to a watermark."""
    out = [("on_sale", times[0])]
    for a, b in zip(times, times[1:]):
        if b - a > timedelta(days=days):
            out += [("probably_sold", a + timedelta(days=days)), ("on_sale", b)]
    if times[-1] + timedelta(days=days) <= mark:
        out.append(("probably_sold", times[-1] + timedelta(days=days)))
    return out


def test_a_key_goes_stale_and_comes_back(spark, tmp_path, rocks):
    """Batch after batch, with a restart between them; the changes are those of the whole history."""
    rng = random.Random(4)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "ck"))
    history, newest = {}, START

    def put(hours, rows):
        nonlocal newest
        made = []
        for i in range(rows):
            ts = START + timedelta(hours=hours + rng.random() * 20)
            key = rng.choice(["a", "b", "c", None]) if i % 3 else "a"
            ok = rng.random() < 0.7
            made.append((i, ts, key, ok))
            newest = max(newest, ts)
            if key and ok:
                history.setdefault(key, set()).add(ts)
        spark.createDataFrame(made + made[:2] + [(99, None, "a", True)], SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        feed = ev.read_stream(spark, src, SCHEMA, files_per_batch=1)
        drain_append(status_changes(feed, "key", days=2, watermark="1 hour", where="ok"), out, state)
        got = spark.read.parquet(out).select("key", "status", F.date_format("changed", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
        return sorted(tuple(r) for r in got)

    def want():
        mark = newest - timedelta(hours=1)
        return sorted((k, s, t.strftime("%Y-%m-%d %H:%M:%S.%f")) for k, ts in history.items() for s, t in changes_of(sorted(ts), 2, mark))

    for hours, rows in ((0, 12), (24, 6), (200, 3)):
        put(hours, rows)
    assert run() == want() == run()
    put(230, 4)
    put(600, 2)
    assert run() == want()


def test_snapshots_while_the_feed_runs(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "ck")
    shots = Snapshots(spark, str(tmp_path / "out"))
    schema = T._parse_datatype_string("n bigint, bad boolean")

    def put(lo, hi):
        for i in range(lo, hi):
            spark.createDataFrame([(i, i == 3), (i + 100, False)], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        shots.follow(ev.read_stream(spark, src, schema, files_per_batch=1), state, F.col("bad"))
        return [(r.no, r.running, r.failed_so_far, r.final) for r in shots.shown().orderBy("no").collect()]

    put(0, 7)
    assert run() == [(1, 2, 0, False), (5, 10, 1, False), (7, 14, 1, True)]
    assert shots.rows(4).count() == 10 and shots.rows(6).count() == 14
    put(7, 10)
    # A batch that is run again replaces its own totals.
    shots.add(spark.read.schema(schema).parquet(src).where("n % 100 = 6"), 6, F.col("bad"))
    assert [x[:3] for x in run()] == [(1, 2, 0), (5, 10, 1), (7, 14, 1), (10, 20, 1)]
    assert Snapshots(spark, str(tmp_path / "none")).shown().count() == 0


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    src, out, state, known = (str(tmp_path / x) for x in ("in", "out", "ck", "known"))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("1.csv", "﻿a,b,c\n1,\"x, \"\"y\"\"\nz\",3\n\n4,5\n".encode())
    put("deep/2.csv", b"c, a ,other\n30,10,zz\n")
    put("3.csv", b"b\n\xff\xfe\n")
    put("empty.csv", b"")
    put("head.csv", b"a,b\n")
    put(".hidden.csv", b"a\n9\n")
    put("_part.csv", b"a\n9\n")
    put("note.txt", b"a\n9\n")

    def run():
        drain_append(watch_headed(spark, src, ["a", "b", "c", "d"], known).drop("feed_path"), out, state)
        return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)

    first = [("1", 'x, "y"\nz', "3", None), ("4", "5", None, None), ("10", None, "30", None), (None, "��", None, None)]
    assert run() == sorted(first, key=str) == run()
    put("4.csv", b"d,a\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(10_000)))
    assert len(run()) == 10_004 == len(run())


def test_both_layouts_under_one_path(spark, tmp_path):
    src, out, state, known = (str(tmp_path / x) for x in ("in", "out", "ck", "known"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lianjia_x.csv").write_text(",".join(RAW_FIELDS_B) + "\n" + ",".join(f"b-{f}" for f in RAW_FIELDS_B) + "\n")
    (tmp_path / "in" / "anjuke_m_y.csv").write_text(",".join(reversed(RAW_FIELDS_A)) + "\n" + ",".join(f"a-{f}" for f in reversed(RAW_FIELDS_A)))
    drain_append(watch_feeds(spark, src, known), out, state)
    got = {r["feed_file"]: r for r in spark.read.parquet(out).collect()}
    assert {f: (r["title"], r["tags"], r["source"], r["source_id"]) for f, r in got.items()} == {
        "lianjia_x.csv": ("b-title", "", "lianjia", "b-source_id"), "anjuke_m_y.csv": ("a-title", "a-tags", "anjuke", "a-source_id")}
