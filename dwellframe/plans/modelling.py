"""Regression, clustering and profile queries."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellframe.operators import clustering as cl
from dwellframe.operators import features as ft
from dwellframe.operators import models as md
from dwellframe.operators import stages
from dwellframe.operators import statistics as st
from dwellframe.plans.features import PREPARED, YEAR, feature_input
from dwellframe.plans.registry import query
from dwellframe.plans.views import listings, on_listings, table
from dwellframe.schema import CLUSTER_FEATURES, MODEL_FEATURES
from dwellframe.session import scratch_path, stage


def _predicted():
    return F.lit(20.0) + F.col("area") * 1.2 - F.col("rooms") * 3.0


@query("regression_metrics", "M7 M10", on_listings("""
    WITH x AS (SELECT CASE WHEN rooms % 2 = 0 THEN 'test' ELSE 'train' END AS side, total_price AS y,
                      20.0 + area * 1.2 - rooms * 3.0 AS p FROM listings)
    SELECT side, count(*) AS rows, round(avg(abs(y - p)), 2) AS mae, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,
           round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM x GROUP BY side"""))
def regression_metrics(spark, sf):
    df = listings(spark, sf, "rooms", "area", "total_price").withColumns({
        "predicted": _predicted(), "side": F.when(F.col("rooms") % 2 == 0, "test").otherwise("train")})
    return md.regression_metrics(df, "total_price", "predicted", "side")


@query("residual_stats", "A36 M10", on_listings("""
    WITH x AS (SELECT total_price - (20.0 + area * 1.2 - rooms * 3.0) AS r FROM listings)
    SELECT round(avg(r), 4) AS residual_mean, round(stddev_pop(r), 4) AS residual_std FROM x"""))
def residual_stats(spark, sf):
    df = listings(spark, sf, "rooms", "area", "total_price").withColumn("predicted", _predicted())
    return st.residual_stats(df, "total_price", "predicted").select(
        *[F.round(c, 4).alias(c) for c in ("residual_mean", "residual_std")])


@query("feature_correlation_rank", "W6 M9", on_listings("""
    WITH c AS (SELECT abs(corr(area, total_price)) AS area, abs(corr(rooms, total_price)) AS rooms,
                      abs(corr(total_floors, total_price)) AS total_floors, abs(corr(unit_price, total_price)) AS unit_price FROM listings),
      l AS (SELECT unnest(['area', 'rooms', 'total_floors', 'unit_price']) AS feature, unnest([area, rooms, total_floors, unit_price]) AS v FROM c)
    SELECT feature, round(v, 6) AS importance, cast(row_number() OVER (ORDER BY v DESC, feature) AS int) AS rank FROM l"""))
def feature_correlation_rank(spark, sf):
    names = ["area", "rooms", "total_floors", "unit_price"]
    df = listings(spark, sf, *names, "total_price")
    wide = df.agg(*[F.abs(F.corr(c, "total_price")).alias(c) for c in names])
    long = wide.unpivot([], names, "feature", "importance")
    return md.rank_importances(long).withColumn("importance", F.round("importance", 6))


@query("importance_comparison", "J10", on_listings("""
    WITH a AS (SELECT district AS feature, sum(area) / (SELECT sum(area) FROM listings) AS importance FROM listings GROUP BY 1),
      b AS (SELECT district AS feature, sum(total_price) / (SELECT sum(total_price) FROM listings WHERE rooms = 1) AS importance
            FROM listings WHERE rooms = 1 AND total_price > 415 GROUP BY 1),
      t AS (SELECT * FROM a ORDER BY importance DESC, feature LIMIT 8)
    SELECT t.feature, round(t.importance * 100, 2) AS left_pct, round(coalesce(b.importance, 0) * 100, 2) AS right_pct
    FROM t LEFT JOIN b USING (feature)"""))
def importance_comparison(spark, sf):
    df = listings(spark, sf, "district", "area", "total_price", "rooms")
    one = df.where("rooms = 1")
    a = df.groupBy(F.col("district").alias("feature")).agg(F.sum("area").alias("w"))
    a = a.withColumn("importance", F.col("w") / df.agg(F.sum("area")).scalar())
    b = one.where("total_price > 415").groupBy(F.col("district").alias("feature")).agg(F.sum("total_price").alias("w"))
    b = b.withColumn("importance", F.col("w") / one.agg(F.sum("total_price")).scalar())
    return md.compare_importances(a, b)


# Fixed cluster labels: the remainder of the part number.
_LABELLED = """x AS (SELECT cast(part_id % 5 AS int) AS cluster, district, decoration, floor_type, unit_price, total_price, area, rooms,
    greatest(least(2026 - greatest(least(build_year, 2025), 1980), 50), 0) AS house_age FROM listings),
  p AS (SELECT cluster, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM x), 1) AS pct,
    round(avg(unit_price), 0) AS avg_unit_price, round(avg(total_price), 1) AS avg_total_price, round(avg(area), 1) AS avg_area,
    round(avg(rooms), 1) AS avg_rooms, round(avg(house_age), 1) AS avg_house_age FROM x GROUP BY cluster)"""


def _labelled(spark, sf):
    df = listings(spark, sf, "part_id", "district", "decoration", "floor_type", "unit_price", "total_price", "area",
                  "rooms", "build_year")
    from dwellframe.functions.housing import clip, house_age
    return df.withColumns({"cluster": (F.col("part_id") % 5).cast("int"),
                           "house_age": house_age(clip(F.col("build_year"), 1980, 2025), 2026)})


@query("cluster_profile", "A26 A27 O9", on_listings(f"""
    WITH {_LABELLED},
      dd AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, decoration) AS r
             FROM (SELECT cluster, decoration, count(*) AS n FROM x GROUP BY cluster, decoration)),
      df AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, floor_type) AS r
             FROM (SELECT cluster, floor_type, count(*) AS n FROM x GROUP BY cluster, floor_type))
    SELECT p.*, dd.decoration AS dominant_decoration, df.floor_type AS dominant_floor FROM p
    JOIN dd ON dd.cluster = p.cluster AND dd.r = 1 JOIN df ON df.cluster = p.cluster AND df.r = 1"""))
def cluster_profile(spark, sf):
    return cl.profile(_labelled(spark, sf)).orderBy(F.desc("pct"), "cluster")


@query("cluster_districts", "W5 M19", on_listings(f"""
    WITH {_LABELLED}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, district) AS rank
        FROM (SELECT cluster, district, count(*) AS count FROM x GROUP BY cluster, district))
    SELECT cluster, district, count, cast(rank AS int) AS rank FROM t WHERE rank <= 3"""))
def cluster_districts(spark, sf):
    return cl.top_districts(_labelled(spark, sf))


@query("cluster_district_matrix", "M19 U6 W5", on_listings(f"""
    WITH {_LABELLED}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, district) AS rank
        FROM (SELECT cluster, district, count(*) AS count FROM x GROUP BY cluster, district)),
      k AS (SELECT * FROM t WHERE rank <= 5)
    SELECT district, {', '.join(f'cast(coalesce(sum(count) FILTER (cluster = {i}), 0) AS bigint) AS "{i}"' for i in range(5))}
    FROM k GROUP BY district"""))
def cluster_district_matrix(spark, sf):
    return cl.district_matrix(_labelled(spark, sf))


@query("cluster_radar", "W11 M19", on_listings(f"""
    WITH {_LABELLED} SELECT cluster, {', '.join(f'round({c} / max({c}) OVER (), 6) AS {c}' for c in cl.RADAR)} FROM p"""))
def cluster_radar(spark, sf):
    rows = cl.radar(cl.profile(_labelled(spark, sf)))
    return rows.select("cluster", *[F.round(c, 6).alias(c) for c in cl.RADAR])


@query("cluster_display", "F35 M19", on_listings(f"""
    WITH {_LABELLED} {' UNION ALL '.join(
        f"SELECT cluster, '{c}' AS dimension, round(greatest({c}, {lo}) / {top} * 100, 1) AS score FROM p"
        for c, (top, lo) in cl.DISPLAY_LIMITS.items())}"""))
def cluster_display(spark, sf):
    return cl.display_radar(cl.profile(_labelled(spark, sf)))


@query("elbow_k1", "M12", on_listings("""
    SELECT 1 AS k, round(var_pop(area) * count(*) + var_pop(rooms) * count(*) + var_pop(total_price) * count(*), 2) AS inertia
    FROM listings"""))
def elbow_k1(spark, sf):
    rows = cl.inertia_one(listings(spark, sf, "area", "rooms", "total_price"), ["area", "rooms", "total_price"])
    return rows.withColumn("inertia", F.round("inertia", 2))


@query("silhouette_sample", "M14 G8", """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings ORDER BY md5(concat('42|', vec_id)), vec_id LIMIT 5000),
      d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
      m AS (SELECT vec_id, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
    SELECT count(*) AS points, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM m""")
def silhouette_sample(spark, sf):
    rows = cl.silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return rows.withColumn("silhouette", F.round("silhouette", 6))


# Learned models: rows only, their scores depend on the tree and start algorithms.
def _model_rows(spark, sf):
    return stage(ft.feature_table(feature_input(spark, sf), "id_key").select(
        "id_key", "is_test", "total_price", "unit_price", *MODEL_FEATURES), "model-rows")


@query("rf_importance", "M5 M9 W6")
def rf_importance(spark, sf):
    model, _ = md.train_and_score(_model_rows(spark, sf), md.forest("total_price"))
    return md.importances(model, table(spark, sf, "nation"))


@query("rf_scores", "M5 M7 S18")
def rf_scores(spark, sf):
    from pyspark.ml.regression import RandomForestRegressionModel
    rows = _model_rows(spark, sf)
    model, _ = md.train_and_score(rows, md.forest("unit_price"))
    path = scratch_path(spark, "model")
    md.save(model, path)
    scored = RandomForestRegressionModel.load(path).transform(md.assemble(rows, MODEL_FEATURES))
    return md.regression_metrics(scored, "unit_price", "predicted", "is_test")


@query("gbt_importance", "M6 M9 W6")
def gbt_importance(spark, sf):
    model, _ = md.train_and_score(_model_rows(spark, sf), md.boosting("total_price"))
    return md.importances(model, table(spark, sf, "nation"))


@query("gbt_unit_importance", "M6 M9 W6")
def gbt_unit_importance(spark, sf):
    model, _ = md.train_and_score(_model_rows(spark, sf), md.boosting("unit_price"))
    return md.importances(model, table(spark, sf, "nation"))


@query("gbt_scores", "M6 M7")
def gbt_scores(spark, sf):
    rows = _model_rows(spark, sf)
    md.use_checkpoints(spark)

    def fit(target):
        return md.train_and_score(rows, md.boosting(target))[1].withColumn("target", F.lit(target))
    with ThreadPoolExecutor(len(TARGETS)) as pool:  # each is hundreds of short jobs
        total, unit = pool.map(inheritable_thread_target(spark)(fit), TARGETS)
    return total.unionByName(unit)


TARGETS = ("total_price", "unit_price")


FORESTS_AT_ONCE, BOOSTED_AT_ONCE = 5, 10  # a forest's fit is a task per tree, a boosted one a single task


def _fit_each(spark, folds, learner, at_once):
    """Several fits run at once and share the executors."""
    def fit(job):
        target, i = job
        return target, i, float(md.score(folds[i], learner(target)))
    jobs = [(target, i) for target in TARGETS for i in range(len(folds))]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), jobs))


def _cv(spark, sf, fits):
    """R² of a full-size model per target over five folds; each fold is encoded by its own training rows."""
    scores = fits(ft.folded_features(feature_input(spark, sf), "id_key"))
    frame = spark.createDataFrame(scores, "target string, fold int, r2 double")
    return frame.groupBy("target").agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"))


@query("cv_scores", "M8 M3")
def cv_scores(spark, sf):
    return _cv(spark, sf, lambda folds: _fit_each(spark, folds, md.forest, FORESTS_AT_ONCE))


@query("cv_boosting_scores", "M8 M3")
def cv_boosting_scores(spark, sf):
    return _cv(spark, sf, lambda folds: _fit_each(spark, folds, md.boosting, BOOSTED_AT_ONCE))


def _scaled(spark, sf):
    return stage(ft.standardise(_model_rows(spark, sf), CLUSTER_FEATURES).select("id_key", *CLUSTER_FEATURES), "scaled")


@query("kmeans", "M11 A26")
def kmeans(spark, sf):
    scaled = _scaled(spark, sf)
    labelled = cl.label(scaled, cl.fit_kmeans(scaled))
    return labelled.groupBy("cluster").agg(F.count("*").alias("count"), *[F.avg(c).alias(c) for c in CLUSTER_FEATURES])


@query("elbow", "M12 M19")
def elbow(spark, sf):
    return cl.elbow(_scaled(spark, sf))


# Squared distances to the mean are those within clusters plus those between them, whatever the clusters are.
_SPREAD = """d AS (SELECT unnest(range(1, len(embedding) + 1)) AS i, embedding FROM embeddings),
    t AS (SELECT sum(v) AS total FROM (SELECT var_pop(embedding[i]::DOUBLE) * count(*) AS v FROM d GROUP BY i)),"""


def _embedded(spark, sf):
    size = 64
    return table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])


@query("kmeans_spread", "M11", f"""
    WITH {_SPREAD} n AS (SELECT count(*) AS rows FROM embeddings)
    SELECT rows, round(total, 3) AS total, round(total, 3) AS within_and_between, 5 AS clusters, 0 AS misplaced FROM t, n""")
def kmeans_spread(spark, sf):
    """Five clusters of all embeddings: their spread adds up, and every row lies with the centre that is its cluster's mean."""
    df = stage(_embedded(spark, sf), "embedded")
    features = [c for c in df.columns if c != "vec_id"]
    run = cl.fit_kmeans(df, 5, features=features)
    own = cl.label(df, run, features)
    means = own.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features])
    whole = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    joined = own.join(F.broadcast(means), "cluster")  # a row per cluster
    to_mean = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in features), F.lit(0.0))
    between = sum(((F.col(f"m_{c}") - whole[c]) ** 2 for c in features), F.lit(0.0))
    total = sum(((F.col(c) - whole[c]) ** 2 for c in features), F.lit(0.0))
    to_centre = [sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(features, centre)), F.lit(0.0)) for centre in run.centres]
    return joined.agg(
        F.count("*").alias("rows"), F.round(F.sum(total), 3).alias("total"),
        F.round(F.sum(to_mean) + F.sum(between), 3).alias("within_and_between"),
        F.countDistinct("cluster").cast("int").alias("clusters"),
        F.count_if(to_mean > F.least(*to_centre) + 0.05).cast("int").alias("misplaced"))


@query("elbow_falls", "M12", f"""
    WITH {_SPREAD} k AS (SELECT unnest(range(1, 11))::INT AS k)
    SELECT k, CASE WHEN k = 1 THEN round(total, 3) END AS spread, true AS falls FROM t, k""")
def elbow_falls(spark, sf):
    """Costs of 1 to 10 clusters of all embeddings, ten starts each: the first is their spread, each next one is smaller."""
    df = stage(_embedded(spark, sf), "embedded")
    rows = cl.elbow(df, features=[c for c in df.columns if c != "vec_id"])
    before = F.lag("inertia").over(Window.partitionBy(F.lit(1)).orderBy("k"))  # ten rows
    return rows.select("k", F.when(F.col("k") == 1, F.round("inertia", 3)).alias("spread"),
                       F.coalesce(F.col("inertia") < before, F.lit(True)).alias("falls"))


_MODELS = {
    "forest": lambda: (stages.price_pipeline(md.forest("total_price")), "predicted"),
    "boosting": lambda: (stages.price_pipeline(md.boosting("unit_price")), "predicted"),
    "kmeans": lambda: (stages.segment_pipeline(), "cluster"),
}


@query("saved_models", "S18 M2 M4 M5 M6 M11", on_listings(f"""
    WITH {PREPARED.format(year=YEAR)}, m AS (SELECT unnest(['forest', 'boosting', 'kmeans']) AS model)
    SELECT model, count(*) AS rows, count(*) FILTER (is_test) AS held_out, 0 AS differing, 0 AS unpredicted FROM m, prepared GROUP BY model"""))
def saved_models(spark, sf):
    """Whole pipelines fitted on the training side, saved, loaded and applied to raw listings, next to the fitted ones."""
    raw = stage(ft.split_by_hash(feature_input(spark, sf), "id_key"), "raw")

    def run(name):
        pipeline, output = _MODELS[name]()
        fitted, path = pipeline.fit(raw.where(~F.col("is_test"))), scratch_path(spark, "pipeline")
        fitted.write().save(path)
        own = fitted.transform(raw).select("id_key", F.col(output).alias("own"))
        loaded = PipelineModel.load(path).transform(raw).select("id_key", "is_test", F.col(output).alias("loaded"))
        return loaded.join(own, "id_key", "left").agg(
            F.lit(name).alias("model"), F.count("*").alias("rows"), F.count_if("is_test").alias("held_out"),
            F.count_if(~F.col("own").eqNullSafe(F.col("loaded"))).cast("int").alias("differing"),
            F.count_if(F.col("loaded").isNull()).cast("int").alias("unpredicted"))
    md.use_checkpoints(spark)
    with ThreadPoolExecutor(len(_MODELS)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(run), _MODELS))
    return reduce(DataFrame.unionByName, parts)


@query("pca", "M13 M19")
def pca(spark, sf):
    scaled = _scaled(spark, sf)
    model = cl.pca_plane(scaled)
    labelled = md.assemble(cl.label(scaled, cl.fit_kmeans(scaled)), CLUSTER_FEATURES)
    share = model.explainedVariance.toArray().tolist()
    return cl.project(model, labelled).select(
        "id_key", "cluster", "pc1", "pc2", F.lit(share[0]).alias("pc1_share"), F.lit(share[1]).alias("pc2_share"))
