"""Operators on small frames: files, order, repeated runs and invariants."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from dwellframe.functions.identity import stable_key
from dwellframe.operators import clustering, dedupe, enrichment, features, filters, increment, mining, synth, topk
from dwellframe.operators.quantiles import exact_median
from dwellframe.schema import RAW_FIELDS_A, RAW_FIELDS_B
from dwellframe.sources import feeds, tables
from dwellframe.streaming import events as ev
from dwellframe.streaming.listing_log import ListingLog
from dwellframe.streaming.sinks import drain_append, drain_versions, newest_versions


def write_csv(path, fields, rows):
    lines = [",".join(fields)] + [",".join(str(r.get(f, "")) for f in fields) for r in rows]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode() + b"\n")


def test_feed_files_to_clean_rows(spark, tmp_path):
    main = [dict(id="1", title="甲", total_price="900000", area="100", community="c", lng="106.5"),
            dict(id="2", title="甲", total_price="80", area="100", community="c"),
            dict(id="3", title="", total_price="50", area="60"), dict(id="4", title="", total_price="60", area="60")]
    write_csv(tmp_path / "anjuke_m_渝中区.csv", RAW_FIELDS_A, main)
    write_csv(tmp_path / "anjuke_m_江北区.csv", RAW_FIELDS_A, [dict(id="9", title="甲", total_price="70", area="90", community="c")])
    write_csv(tmp_path / "all_listings_merged.csv", RAW_FIELDS_A,
              [dict(id="5", title="甲", district="渝中区", total_price="77", area="100", community="c"),
               dict(id="6", title="乙", district="渝中区", total_price="88", area="100", community="c"),
               dict(id="7", title="乙", district="渝中区", total_price="99", area="100", community="c")])
    write_csv(tmp_path / "lianjia_渝中区.csv", RAW_FIELDS_B, [dict(id="8", title="甲", total_price="5000000", area="100", source_id="8")])
    a = feeds.read_feed(spark, [str(tmp_path / "anjuke_m_*.csv"), str(tmp_path / "all*.csv")], RAW_FIELDS_A)
    b = feeds.read_feed(spark, str(tmp_path / "lianjia_*.csv"), RAW_FIELDS_B)
    raw = feeds.union_feeds(a, b)
    order = ["feed_file", "block", "line"]
    rows = feeds.repair(feeds.normalise(raw, carry=["block", "line"]))
    kept = dedupe.clean(rows, order).select("title", "district", "source", "total_price", "repair_rule").collect()
    assert sorted((r.title, r.district, r.source, r.total_price) for r in kept) == sorted([
        ("甲", "渝中区", "anjuke", 90.0), ("", "渝中区", "anjuke", 50.0), ("", "渝中区", "anjuke", 60.0),
        ("甲", "江北区", "anjuke", 70.0), ("乙", "渝中区", "anjuke", 88.0), ("甲", "渝中区", "lianjia", 5000000.0)])
    m = dedupe.clean_metrics(rows, order).first()
    assert m.total_read == 9 and m.final_count == 6 and m.price_fixed == 1 and m.lng_ok == 1
    assert m.total_read - m.intra_file_dup_title - m.cross_file_dup - m.fingerprint_dup == m.final_count


def test_metrics_repair_main_rows_alone_for_their_count(spark):
    rows = spark.createDataFrame([(0, "f", "a", "1"), (0, "f", "a", "2"), (1, "g", "a", "3"), (1, "g", "b", "4"), (2, "h", "b", "5")],
                                 "feed_rank int, feed_file string, title string, id string")
    fixed = F.when(F.col("feed_rank") == 0, F.col("id") == "1").otherwise(F.raise_error("not to be read").cast("boolean"))
    rows = rows.select("*", F.lit("c").alias("community"), F.lit("d").alias("district"), F.lit("s").alias("source"),
                       F.lit("1").alias("lng"), F.col("id").alias("fingerprint"), fixed.alias("price_fixed"))
    m = dedupe.clean_metrics(rows, ["id"]).first()
    assert (m.total_read, m.price_fixed, m.cross_file_dup, m.intra_file_dup_title, m.final_count) == (5, 1, 2, 1, 2)


def test_file_order_decides(spark, tmp_path):
    rows = [dict(id=str(i), title=f"t{i % 50}", total_price="80", area="100") for i in range(5000)]
    write_csv(tmp_path / "anjuke_m_x.csv", RAW_FIELDS_A, rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits of one file
    raw = feeds.read_feed(spark, str(tmp_path / "anjuke_m_x.csv"), RAW_FIELDS_A)
    kept = dedupe.unique_titles(raw, ["block", "line"]).select("id").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(int(r.id) for r in kept) == list(range(50))


def test_tolerant_reader_returns_nothing_for_missing_columns(spark, tmp_path):
    (tmp_path / "anjuke_bad.csv").write_bytes(b"id,title\n1,\xff\xfe broken\n2\n")
    rows = feeds.read_feed(spark, str(tmp_path / "anjuke_bad.csv"), RAW_FIELDS_A, tolerant=True).collect()
    assert [r.id for r in rows] == ["1", "2"] and rows[0].area is None




@pytest.mark.parametrize("label,rank,clean,rich,update", [
    ("anjuke_m_渝中区.csv", 0, "渝中区", "m_渝中区", "m_渝中区"),
    ("anjuke_fast_渝中区.csv", 2, "渝中区", "渝中区", "fast_渝中区"),
    ("lianjia_渝中区.csv", 3, "渝中区", "lianjia_渝中区", "渝中区"),
    ("anjuke_all.csv", 1, "all", "all", "all")])
def test_feed_names(spark, label, rank, clean, rich, update):
    c = F.lit(label)
    r = spark.range(1).select(feeds.feed_class(c).alias("k"), *[
        feeds.district_from_name(c, s).alias(s) for s in ("clean", "rich", "update")]).first()
    assert (r.k, r.clean, r.rich, r.update) == (rank, clean, rich, update)


def test_dedupe_is_idempotent(spark):
    rng = random.Random(3)
    rows = [(i, f"f{rng.randint(0, 30)}" if rng.random() > 0.3 else "") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, fingerprint string")
    once = dedupe.unique_fingerprints(df, ["i"])
    assert sorted(once.collect()) == sorted(dedupe.unique_fingerprints(once, ["i"]).collect())
    assert once.where("fingerprint = ''").count() == sum(1 for _, f in rows if f == "")


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("fingerprint", (F.col("id") % 2).cast("string"))
    plan = dedupe.unique_fingerprints(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 70 + [1.0, 9.0], [0.0, 1e-300, 1e300], list(range(1001)),
                                    [float("inf")] * 3 + [1.0, 2.0], [-float("inf"), 5.0, float("inf")], [-1e308, 1e308, 1e308, 3.0],
                                    [0.0, 5e-324, 1e-323], [float("inf")] + [x / 7 for x in range(30000)], [-float("inf"), 1.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert exact_median(df, "x") == statistics.median(values)


def test_exact_median_random(spark):
    rng = random.Random(1)
    xs = [rng.lognormvariate(0, 5) for _ in range(4000)]
    assert exact_median(spark.createDataFrame([(x,) for x in xs], "x double"), "x") == statistics.median(xs)


def test_upsert_actions(spark):
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    old = spark.createDataFrame([("a", 100.0, 1.0, "on_sale"), ("b", 100.0, 1.0, "on_sale"), ("c", 100.0, 1.0, "probably_sold"),
                                 ("d", 1.0, 1.0, "on_sale")], "key string, total_price double, unit_price double, status string")
    old = old.withColumns({"first_seen": t, "last_updated": t})
    new = spark.createDataFrame([("a", 100.05, 5.0), ("b", 101.0, 2.0), ("c", 90.0, 3.0), ("e", 7.0, 7.0), ("", 1.0, 1.0), ("lj_", 1.0, 1.0)],
                                "key string, total_price double, unit_price double")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    r = {x.key: x for x in increment.upsert(old, new, "key", now).collect()}
    assert {k: v.action for k, v in r.items()} == {"a": "same", "b": "price", "c": "relisted", "d": "untouched", "e": "new"}
    assert (r["a"].total_price, r["b"].total_price, r["c"].total_price, r["c"].status) == (100.0, 101.0, 100.0, "on_sale")
    assert str(r["a"].last_updated) == "2024-02-01 00:00:00" and str(r["d"].last_updated) == "2024-01-01 00:00:00"
    assert increment.skipped_rows(new, "key").count() == 2
    # A relisted row keeps its price once; the next run takes the new one, after that nothing changes.
    table, runs = old, []
    for _ in range(3):
        table = increment.upsert(table, new, "key", now)
        runs.append({x.key: x.action for x in table.collect()})
        table = table.drop("action")
    assert runs[1] == {"a": "same", "b": "same", "c": "price", "d": "untouched", "e": "same"}
    assert set(runs[2].values()) == {"same", "untouched"}


def test_listing_log_equals_sequential_batches(spark, tmp_path):
    cols = "key string, total_price double, unit_price double, status string, first_seen timestamp_ntz, last_updated timestamp_ntz"
    start = spark.createDataFrame([(f"k{i}", 100.0 + i, 1.0, "on_sale", None, None) for i in range(10)], cols)
    log = ListingLog(spark, str(tmp_path / "log"), "key", compact_every=2)
    log.load(start)
    want, rng = start, random.Random(5)
    for n in range(5):
        now = F.lit(f"2024-01-0{n + 1}").cast("timestamp_ntz")
        batch = spark.createDataFrame([(f"k{rng.randint(0, 14)}", rng.uniform(90, 120), 2.0, i) for i in range(6)],
                                      "key string, total_price double, unit_price double, seq int")
        log.apply(batch, n, now, "seq")
        log.apply(batch, n, now, "seq")  # a replayed batch changes nothing
        one = increment.one_per_key(batch, "key", "seq").drop("seq")
        want = increment.upsert(want, one, "key", now).drop("action")
    assert sorted(map(str, log.current().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def brute_force(transactions, s, k):
    n, out = len(transactions), {}
    for size in range(1, k + 1):
        seen = {}
        for t in transactions:
            for c in itertools.combinations(sorted(t), size):
                seen[c] = seen.get(c, 0) + 1
        out.update({c: v for c, v in seen.items() if v / n >= s})
    return out


def test_itemsets_and_rules_against_brute_force(spark):
    rng = random.Random(7)
    data = [sorted({f"d{d}={rng.randint(0, 2)}" for d in range(5) if rng.random() > 0.2}) for _ in range(400)]
    data = [t for t in data if len(t) >= 3]
    df = spark.createDataFrame([(t,) for t in data], "t array<string>")
    for length in (1, 2, 3, 4):
        sets = mining.frequent_itemsets(mining.transactions(df, F.col("t")), 0.1, length)
        got = {tuple(r["items"]): r["count"] for r in sets.collect()}
        assert got == brute_force(data, 0.1, length)
    assert mining.frequent_itemsets(mining.transactions(df, F.col("t")), 1.0).count() == 0
    assert mining.frequent_itemsets(mining.transactions(df.limit(0), F.col("t")), 0.1).count() == 0
    n = len(data)
    for r in mining.rules(sets, 0.4).collect():
        whole = tuple(sorted([*r.antecedent, *r.consequent]))
        conf = got[whole] / got[tuple(r.antecedent)]
        assert conf >= 0.4 and r.confidence == pytest.approx(conf, abs=6e-5)
        assert r.lift == pytest.approx(conf / (got[tuple(r.consequent)] / n), abs=6e-5)
    expected = sum(1 for whole in got if len(whole) > 1 for m in range(1, len(whole)) for a in itertools.combinations(whole, m)
                   if got[whole] / got[a] >= 0.4)
    assert mining.rules(sets, 0.4).count() == expected


def test_encoding_does_not_see_test_targets(spark):
    rows = [("d", "c", 100.0, False)] * 6 + [("d", "c", 900.0, True)] * 6 + [("e", "x", 50.0, False)]
    df = spark.createDataFrame(rows, "district string, community string, unit_price double, is_test boolean")
    train = {(r.district, r.district_encoded, r.community_encoded) for r in features.target_encode(df, "train").collect()}
    assert train == {("d", 100.0, 100.0), ("e", 100.0, 100.0)}
    whole = {(r.district, r.district_encoded) for r in features.target_encode(df, "all").collect()}
    assert ("d", 500.0) in whole


def test_silhouette_against_definition(spark):
    rng = random.Random(2)
    pts = [(i, [rng.gauss(3 * (i % 3), 1), rng.gauss(0, 1)], i % 3) for i in range(60)] + [(99, [50.0, 50.0], 7)]
    def dist(a, b): return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    total = 0.0
    for i, v, c in pts:
        groups = {}
        for j, w, d in pts:
            if i != j:
                groups.setdefault(d, []).append(dist(v, w))
        if c not in groups:
            continue
        a = sum(groups[c]) / len(groups[c])
        b = min(sum(g) / len(g) for d, g in groups.items() if d != c)
        total += (b - a) / max(a, b)
    df = spark.createDataFrame(pts, "id int, v array<double>, c int")
    assert clustering.silhouette(df, "id", "v", "c").first().silhouette == pytest.approx(total / len(pts))


def test_inertia_falls_with_k(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(i % 4 * 5, 1), rng.gauss(i % 2 * 5, 1)) for i in range(400)], "x double, y double")
    costs = [r.inertia for r in clustering.elbow(df, range(2, 5), 2, ["x", "y"]).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True) and len(costs) == 4


def test_synthetic_rows_are_tagged_new_and_complete(spark):
    rng = random.Random(9)
    cats = ["低层", "中层", "高层"]
    rows = [(f"d{0 if i % 3 else i % 4}", f"c{rng.randint(0, 40)}", rng.uniform(5e3, 2e4), rng.uniform(40, 300), rng.uniform(40, 200), rng.randint(1, 5),
             1, 1, rng.choice(cats), "南", "精装", 18, 2005, 106.5, 29.5, f"fp{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "district string, community string, unit_price double, total_price double, area double, rooms int, halls int, "
                               "bathrooms int, floor_type string, orientation string, decoration string, total_floors int, build_year int, "
                               "lng double, lat double, fingerprint string")
    made = synth.generate(df, 1500).persist()
    want = {r.district: r.quota for r in synth.quotas(synth.district_profile(df), 600).collect()}
    assert {r.district: r["count"] for r in made.groupBy("district").count().collect()} == want
    assert made.where("not is_synthetic or source <> 'augmented'").count() == 0
    assert made.select("fingerprint").distinct().count() == made.count()
    assert made.where("area < 15 or area > 400 or build_year < 1980 or build_year > 2025 or total_price < 3").count() == 0
    known = df.select("district", "community").distinct()
    assert made.join(known, ["district", "community"], "left_anti").count() == 0
    assert filters.real_only(made).count() == 0
    first = sorted(map(str, made.collect()))
    assert first == sorted(map(str, synth.generate(df.repartition(5), 1500).collect()))
    made.unpersist()


def test_synthetic_rows_are_spread_and_looked_up_without_a_merge(spark):
    quota = spark.createDataFrame([("d1", 60_000)], "district string, quota long")
    sizes = [len(x) for x in synth.number_rows(quota).rdd.glom().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 60_000
    real = spark.range(100).select(
        F.lit("d1").alias("district"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("community"),
        *[F.lit(v).alias(k) for k, v in dict(
            unit_price=9000.0, total_price=90.0, area=100.0, rooms=3, halls=1, bathrooms=1, floor_type="中层", orientation="南",
            decoration="精装", total_floors=20, build_year=2010, lng=106.5, lat=29.5).items()])
    rows = synth.draw(synth.number_rows(quota), synth.district_profile(real), synth.pick_tables(real),
                      synth.communities(real), 42)
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 60_000 and rows.select("community").distinct().count() == 7


def test_synthetic_collisions_are_replaced(spark):
    df = spark.createDataFrame([(f"d{i % 2}", "c", 1e4, 100.0, 90.0, 2, 1, 1, "低层", "南", "精装", 18, 2005, 0.0, 0.0) for i in range(100)],
                               "district string, community string, unit_price double, total_price double, area double, rooms int, halls int, bathrooms int, "
                               "floor_type string, orientation string, decoration string, total_floors int, build_year int, lng double, lat double")
    real = df.withColumn("fingerprint", stable_key(F.monotonically_increasing_id()))
    first = synth.generate(real, 200, minimum=50)
    clash = real.unionByName(first.limit(10).select(*real.columns))
    again = synth.generate(clash, 210, minimum=50)
    assert again.count() >= 100
    assert again.join(clash, "fingerprint", "left_semi").count() == 0


def test_paging_covers_everything_once(spark):
    df = spark.range(95).withColumn("x", F.col("id") * 2)
    pages = [[r.id for r in topk.page(df, "id", p, 20).collect()] for p in range(1, 6)]
    assert sum(pages, []) == list(range(95))
    assert [r.id for r in topk.page_after(df, "id", 39, 20).collect()] == pages[2]
    with pytest.raises(ValueError):
        topk.page(df, "id", 1, 51)


def test_search_ignores_empty_arguments(spark):
    df = spark.createDataFrame([(100.0, "a%b", "x"), (100.0, "ab", "y"), (6000.0, "ab", "y")], "total_price double, orientation string, district string")
    assert filters.search(df, district="", orientation=None).count() == 2
    assert filters.search(df, orientation="a%").count() == 1
    assert filters.search(df, orientation="a%", wildcards=True).count() == 2


def test_results_are_replaced_by_type(spark, tmp_path):
    path, now = str(tmp_path / "r"), F.lit("2024-01-01").cast("timestamp")
    tables.store_result(spark.range(3), path, "a", now)
    tables.store_result(spark.range(5), path, "b", now)
    tables.store_result(spark.range(2), path, "a", now)
    assert tables.read_result(spark, path, "a", "id bigint").count() == 2
    assert tables.read_result(spark, path, "b", "id bigint").count() == 5


def test_progress_formats(spark):
    df = spark.createDataFrame([('{"pages_done": [1, 2], "pages_failed": [3], "total_crawled": 2}',), ("[4, 5, 6]",), ("broken",)], "p string")
    rows = [(r.pages_done, r.pages_failed, r.total_crawled) for r in tables.parse_progress(df, "p").collect()]
    assert rows == [([1, 2], [3], 2), ([4, 5, 6], [], 0), ([], [], 0)]


def test_streams_resume_and_do_not_repeat(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    def put(lo, hi):
        spark.range(lo, hi).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id AS int)) AS ts",
                                       "id % 7 AS user_id", "'view' AS event_type", "1.5 AS value").select(
            "event_id", "ts", "user_id", "event_type", F.col("value").cast("double").alias("value")).write.mode("append").parquet(src)
    from pyspark.sql import types as T
    parsed = T._parse_datatype_string(schema)
    def run():
        drain_versions(ev.window_counts(ev.read_stream(spark, src, parsed), "1 day"), out, state)
        return {str(r.start): r.rows for r in newest_versions(spark, out, ["start"]).collect()}
    put(0, 30)
    assert run() == {"2024-01-01 00:00:00": 24, "2024-01-02 00:00:00": 6}
    put(30, 60)
    assert run() == {"2024-01-01 00:00:00": 24, "2024-01-02 00:00:00": 24, "2024-01-03 00:00:00": 12}
    assert sum(run().values()) == 60
    out2 = str(tmp_path / "out2")
    for _ in range(2):
        drain_append(ev.unique_feed(ev.read_stream(spark, src, parsed), ["user_id"], "30 days").select("user_id"), out2, str(tmp_path / "ck2"))
    assert spark.read.parquet(out2).count() == 7


def test_snapshots(spark):
    df = spark.createDataFrame([(i, 10, int(i == 3)) for i in range(12)], "batch int, rows int, failed int")
    rows = ev.snapshots(df).orderBy("no").collect()
    assert [(r.no, r.running, r.failed_so_far) for r in rows] == [(1, 10, 0), (5, 50, 1), (10, 100, 1), (12, 120, 1)]


def test_registry_loads_without_a_session():
    import subprocess
    import sys
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    root = __file__.rsplit("/tests/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_wall_clock_does_not_follow_the_session_zone(spark):
    from dwellframe.functions.times import hours_since, utc_instant, utc_wall
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.5' AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York", "Asia/Shanghai"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        r = df.select(utc_wall(utc_instant(F.col("t"))).alias("w"), F.unix_micros(utc_instant(F.col("t"))).alias("m"),
                      hours_since(F.col("t"), "2024-03-10").alias("h")).first()
        assert (str(r.w), r.m, r.h) == ("2024-03-10 02:30:00.500000", 1710037800500000, 2)
    spark.conf.set("spark.sql.session.timeZone", before)


def test_mixed_layouts_are_read_by_name(spark, tmp_path):
    write_csv(tmp_path / "anjuke_m_x.csv", RAW_FIELDS_A, [dict(id="1", source="a", source_id="s1", tags="t", fingerprint="f1")])
    write_csv(tmp_path / "lianjia_x.csv", RAW_FIELDS_B, [dict(id="2", source="b", source_id="s2", fingerprint="f2")])
    (tmp_path / "anjuke_short.csv").write_text("title, id\n甲,3\n")
    for layout in (RAW_FIELDS_A, None):
        rows = {r.id: r for r in feeds.read_feed(spark, str(tmp_path), layout).collect()}
        assert [(rows[i].source, rows[i].source_id, rows[i].tags, rows[i].fingerprint) for i in "123"] == [
            ("a", "s1", "t", "f1"), ("b", "s2", None, "f2"), (None, None, None, None)]
        assert rows["3"].title == "甲"
    missing = str(tmp_path / "no such folder")
    none = feeds.read_feed(spark, missing, RAW_FIELDS_A, tolerant=True)
    assert none.count() == 0 and none.columns[:len(RAW_FIELDS_A)] == RAW_FIELDS_A
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.read_feed(spark, missing, RAW_FIELDS_A)


def test_feed_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", "甲"), ("2", "乙")], "id string, title string")
    feeds.write_feed(df, str(tmp_path / "out"), ["id", "title", "tags"], mark=True)
    parts = [f.read_bytes() for f in (tmp_path / "out").glob("part-*")]
    assert all(p.startswith(b"\xef\xbb\xbfid,title,tags") for p in parts if p)
    assert sorted(r.id for r in feeds.read_feed(spark, str(tmp_path / "out")).collect()) == ["1", "2"]


def test_detail_rows_never_multiply_listings(spark):
    rows = spark.createDataFrame([("k", None, 1.0), ("", None, 1.0), (None, None, 1.0), ("x", "old", 1.0)],
                                 "id string, decoration string, unit_price double")
    detail = spark.createDataFrame([("k", "first", 1), ("k", "second", 2), ("", "blank", 3), (None, "null", 4), ("x", "new", 5)],
                                   "id string, decoration string, no int")
    filled = enrichment.fill_missing(rows, detail, "id", order="no").collect()
    assert sorted(map(str, ((r.id, r.decoration, r.filled) for r in filled))) == sorted(map(str, [
        ("k", "second", 1), ("", None, 0), (None, None, 0), ("x", "old", 0)]))
    over = {r.id: r.decoration for r in enrichment.overwrite_present(rows, detail, "id", order="no").collect()}
    assert over == {"k": "second", "": None, None: None, "x": "new"}


def test_blank_titles_match_nothing(spark):
    rows = spark.createDataFrame([("d", ""), ("d", None), ("d", "t"), ("e", "t")], "district string, title string")
    scanned = spark.createDataFrame([("d", "", "1"), ("d", "t", "3"), ("d", "t", "2")], "district string, title string, id string")
    got = enrichment.match_titles(rows, scanned, "title", "id", "id", by=["district"])
    assert sorted(map(str, ((r.district, r.title, r.matched) for r in got.collect()))) == sorted(map(str, [
        ("d", "", None), ("d", None, None), ("d", "t", "2"), ("e", "t", None)]))


def test_null_status_is_relisted(spark):
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    old = spark.createDataFrame([("a", 100.0, 1.0, None)], "key string, total_price double, unit_price double, status string")
    old = old.withColumns({"first_seen": t, "last_updated": t})
    new = spark.createDataFrame([("a", 100.0, 1.0)], "key string, total_price double, unit_price double")
    r = increment.upsert(old, new, "key", t).first()
    assert (r.action, r.status) == ("relisted", "on_sale")


def test_open_quotas_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(synth, "draw", lambda rows, *_: rows.where("false").select(
        "district", *[F.lit(None).cast("string").alias(c) for c in synth.OUTPUT if c != "district"]))
    df = spark.createDataFrame([("d", f"c{i}", 1.0, 1.0, 1.0, 1, 1, 1, "f", "o", "e", 1, 2000, 1.0, 1.0, str(i)) for i in range(12)],
                               "district string, community string, unit_price double, total_price double, area double, rooms int, "
                               "halls int, bathrooms int, floor_type string, orientation string, decoration string, total_floors int, "
                               "build_year int, lng double, lat double, fingerprint string")
    with pytest.raises(RuntimeError, match="quotas"):
        synth.generate(df, 30, attempts=2)


def test_listing_log_opens_its_files_and_drops_old_bases(spark, tmp_path):
    from dwellframe.streaming.listing_log import ListingLog
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    cols = "key string, total_price double, unit_price double, status string"
    stored = spark.createDataFrame([(f"k{i}", 1.0, 1.0, "on_sale") for i in range(50)], cols).withColumns({"first_seen": t, "last_updated": t})
    log = ListingLog(spark, str(tmp_path / "log"), "key", compact_every=1, rows_per_file=5)
    log.load(stored)
    for b in range(4):
        batch = spark.createDataFrame([("k1", 10.0 + b, 1.0, 1), (f"n{b}", 5.0, 1.0, 1)], "key string, total_price double, unit_price double, no int")
        log.apply(batch, b, t, "no")
    rows = {r.key: r.total_price for r in log.current().collect()}
    assert len(rows) == 54 and rows["k1"] == 13.0 and rows["n3"] == 5.0
    assert len(list((tmp_path / "log" / "base").glob("batch=*"))) == 2
    assert len(log.current().inputFiles()) == 11
    one = log.current(spark.createDataFrame([("k1",)], "key string"))
    assert len(one.inputFiles()) == 1 and one.first().total_price == 13.0


def test_cross_validation_scores_the_full_models(spark, monkeypatch):
    from dwellframe.plans import modelling

    seen = []
    monkeypatch.setattr(modelling.md, "score", lambda rows, model: seen.append(model) or 0.5)
    for build, name, size, depth in ((modelling.cv_scores, "numTrees", 200, 15), (modelling.cv_boosting_scores, "maxIter", 200, 6)):
        seen.clear()
        rows = build(spark, "/root/testdata/sf0.001").collect()
        assert {r["target"] for r in rows} == {"total_price", "unit_price"} and len(seen) == 10
        assert {(m.getOrDefault(name), m.getMaxDepth()) for m in seen} == {(size, depth)}
