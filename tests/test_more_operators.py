import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brinework.functions import scalars
from brinework.operators import anomaly, charts, cleaning, hypothesis_tests, impute, insights, kpi, models, profile, quality, ranks, recipes, relational, timeseries
from brinework.sources import files
from brinework.sources.star import Star


def some(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0.0, rng.randint(0, 9), rng.gauss(0, 5)]), float(rng.randint(-3, 3)) if rng.random() < 0.9 else None, rng.choice(["a", "b", None])) for i in range(n)]
    return rows, spark.createDataFrame([(i, None if x is None else float(x), y, g) for i, x, y, g in rows], "i long, x double, y double, g string").repartition(5)


def test_order_statistics(spark):
    rows, df = some(spark)
    x, y = (np.sort([float(v) for v in col if v is not None]) for col in zip(*((r[1], r[2]) for r in rows), strict=True))
    found = ranks.order_statistics(df, ["x", "y", "i"], lambda n: range(0, n, 97))
    assert [n for n, _ in found] == [len(x), len(y), len(rows)]
    assert found[0][1] == {k: x[k] for k in range(0, len(x), 97)} and found[1][1] == {k: y[k] for k in range(0, len(y), 97)}
    got = {r.column: list(r.q) for r in ranks.quantile_table(df, ["x", "y"], (0.0, 0.13, 0.5, 1.0)).collect()}
    assert got["x"] == pytest.approx(np.quantile(x, [0.0, 0.13, 0.5, 1.0])) and got["y"] == pytest.approx(np.quantile(y, [0.0, 0.13, 0.5, 1.0]))
    assert ranks.quantile_table(df.limit(0), ["x"], (0.5,)).count() == 0 and ranks.quantile_row(df.limit(0), ["x"], (0.5,)).first()[0] is None
    one = spark.createDataFrame([(7.0, None)], "a double, b double")
    assert ranks.order_statistics(one, ["a", "b"], lambda n: [0, n - 1]) == [(1, {0: 7.0}), (0, {})]


def test_order_statistics_of_many_rows_by_brackets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    df = spark.range(40_000).select((F.xxhash64("id") % 9973).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 100).cast("double").alias("w"))
    v, w = (np.sort(np.array([r[0] for r in df.select(c).collect()])) for c in "vw")
    at = lambda n: [0, 1, 2, n // 4, n // 2, n - 2, n - 1]
    found = ranks.order_statistics(df, ["v", "w"], at)
    assert found[0][1] == {k: v[k] for k in at(len(v))} and found[1][1] == {k: w[k] for k in at(len(w))}


def test_running_counts(spark):
    rows, df = some(spark, 2)
    for by in ([], ["g"]):
        got = {(r["g"] if by else None, r["x"]): r["before"] for r in ranks.running(ranks.sizes_of(df, "x", by), "x", by).collect()}
        values = {}
        for _, x, _, g in rows:
            if x is not None:
                values.setdefault(g if by else None, []).append(float(x))
        assert got == {(k, v): sum(u < v for u in own) for k, own in values.items() for v in set(own)}


def tau(x, y):
    s = sum(np.sign(a - c) * np.sign(b - d) for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2))
    n, t = len(x) * (len(x) - 1) / 2, lambda v: sum(k * (k - 1) / 2 for k in np.unique(v, return_counts=True)[1])
    return s / math.sqrt((n - t(x)) * (n - t(y)))


def test_kendall(spark):
    rows, df = some(spark, 3, 700)
    got = {(r.a, r.b): r.tau for r in profile.kendall(df, ["i", "x", "y"]).collect()}
    cols = {"i": 0, "x": 1, "y": 2}
    for a, b in itertools.combinations("ixy", 2):
        both = [(float(r[cols[a]]), float(r[cols[b]])) for r in rows if r[cols[a]] is not None and r[cols[b]] is not None]
        assert got[a, b] == pytest.approx(tau(*map(np.array, zip(*both, strict=True))))
    assert profile.kendall(df.limit(0), ["x", "y"]).count() == 0
    three = profile.strong_pairs(profile.correlations(df.selectExpr("x", "-x as z")), 0.9).first()
    assert three.agreement == "all_agree" and three.perfect and three.direction == "negative" and three.strength == "very_strong"
    with pytest.raises(ValueError):
        profile.correlations(df, "cosine")


def test_density_noise(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([0, 3, 6]) + rng.gauss(0, 0.3), rng.choice([0, 4]) + rng.gauss(0, 0.3), rng.gauss(0, 0.4)) for i in range(250)] + [(900, 0.0, 0.0, 0.0)] * 3
    df = spark.createDataFrame(points, "i long, a double, b double, c double")
    for cols, eps, least in ((1, 0.05, 3), (2, 0.3, 4), (3, 0.5, 5)):
        x = np.array([p[1 : 1 + cols] for p in points])
        near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
        core = near.sum(axis=1) >= least
        want = ~core & ~(near & core[None]).any(axis=1)
        got = {(r.i, r.is_noise) for r in anomaly.dbscan_noise(df, ["a", "b", "c"][:cols], eps, least).collect()}
        assert got == {(p[0], bool(w)) for p, w in zip(points, want, strict=True)}


def test_density_noise_in_many_columns(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.choice([0.0, 2.0], size=(4, 6))[rng.integers(0, 4, 150)] + rng.normal(size=(150, 6)) * 0.12, rng.uniform(-1, 3, size=(30, 6)), np.zeros((4, 6))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i long, a double, b double, c double, d double, e double, f double")
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.5**2
    core = near.sum(axis=1) >= 5
    want = ~core & ~(near & core[None]).any(axis=1)
    got = {r.i: r.is_noise for r in anomaly.dbscan_noise(df, list("abcdef"), 0.5, 5).collect()}
    assert 0 < want.sum() < 100 and all(got[i] == bool(w) for i, w in enumerate(want))


def test_density_noise_gathers_nothing_on_the_driver(spark):
    df = spark.range(300).selectExpr("id as i", "id % 20 * 1.0 as a", "id % 7 / 2.0 as b", "id % 5 / 2.0 as c")
    plan = anomaly.dbscan_noise(df, ["a", "b", "c"], 0.8, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_outliers_by_all_methods(spark):
    df = spark.range(200).selectExpr("cast(id as double) as a", "cast(if(id = 7, 9000, id % 5) as double) as b")
    found = anomaly.by_all_methods(df)
    assert sorted(found) == ["consensus", "iqr", "isolation_forest", "zscore"]
    assert found["isolation_forest"].first().samples == 200 and found["consensus"].count() == 2


def test_merge_meets_null_keys_as_pandas_does(spark):
    a = [(1, None, 1.0), (2, "x", 2.0), (None, None, 3.0), (5, "z", 4.0)]
    b = [(1, None, 10.0), (2, "y", 20.0), (None, None, 30.0), (6, "w", 40.0)]
    frames = [spark.createDataFrame(rows, f"k int, t string, v double, {n} int".replace(f", {n} int", "")) for n, rows in (("p", a), ("q", b))]
    for how in ("inner", "left", "right", "outer"):
        got = relational.merge(frames, ["k", "t"], how)
        want = pd.DataFrame(a, columns=["k", "t", "v"]).merge(pd.DataFrame(b, columns=["k", "t", "v"]), on=["k", "t"], how=how)
        assert got.columns == list(want.columns)
        plain = lambda rows: sorted([tuple(None if x is None or x != x else x for x in r) for r in rows], key=str)
        assert plain(got.collect()) == plain(want.itertuples(index=False, name=None))
    assert relational.merge(frames, ["k", "t"], "left_anti").count() == 2 and relational.merge([*frames, frames[0].withColumnRenamed("v", "z")], ["k", "t"]).columns == ["k", "t", "v_x", "v_y", "z"]


def test_csv_files_of_two_encodings(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("n,t\n1,café\n".encode())
    (tmp_path / "c.csv").write_bytes("n,t\n2,caf\xe9\n".encode("latin-1"))
    got = files.read(spark, str(tmp_path), "csv")
    assert {tuple(r) for r in got.collect()} == {(1, "café"), (2, "café")} and dict(got.dtypes)["n"] == "int"
    assert files.read(spark, str(tmp_path / "c.csv")).first().t == "café" and files.read(spark, str(tmp_path / "a b.csv")).first().t == "café"


def test_shapiro_wilk_against_published_values(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = hypothesis_tests._shapiro([float(v) for v in weights])
    assert w == pytest.approx(0.78881, abs=1e-4) and p == pytest.approx(0.00670, abs=1e-4)
    df = spark.createDataFrame([(float(v),) for v in weights], "v double")
    assert hypothesis_tests.shapiro_wilk(df, "v").first().normal is False
    assert hypothesis_tests.shapiro_wilk(df.limit(2), "v").first().statistic is None
    normal = spark.createDataFrame([(x,) for x in np.random.default_rng(1).normal(size=400).tolist()], "v double")
    assert hypothesis_tests.normality(normal).first().consensus == "normal"


def test_knn_looks_along_one_column_only():
    rng = np.random.default_rng(11)
    donors = pd.DataFrame({"_c0": rng.normal(size=5000) * 100, "_c1": rng.integers(0, 9, 5000) / 1.0, "_c2": rng.normal(size=5000), "tie": rng.permutation(5000), "n": 1})
    rows = pd.DataFrame({"_q0": rng.normal(size=40) * 100, "_q1": rng.integers(0, 9, 40) / 1.0, "_q2": np.nan, "bound": np.inf})
    got = impute._nearest(donors, rows, impute.Search([0, 1], 0, [2], []), 3, 5)
    for q in rows.itertuples():
        far = (((q._1 - donors["_c0"]) ** 2 + (q._2 - donors["_c1"]) ** 2) * 3 / 2).to_numpy()
        mine = got[(got["_c0"] == q._1) & (got["_c1"] == q._2)]
        best = np.lexsort((donors["tie"], far))[:5]
        assert mine[mine["column"] == 2]["value"].tolist() == pytest.approx(donors["_c2"].to_numpy()[best])
        assert mine[mine["column"] == -1]["distance"].tolist() == pytest.approx([far[best[-1]]])


def test_equal_rows_are_one_before_they_meet_every_pair(spark):
    df = spark.range(400).selectExpr("id % 3 as a", "id % 2 * 1.0 as b", "if(id % 5 = 0, null, id % 7) as c")
    cells = profile._pair_cells(df, ["a", "b", "c"])
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
    x = df.toPandas()
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        want = x[[a, b]].dropna().value_counts()
        assert {(r.x, r.y): r.w for r in cells.where(f"a = '{a}' and b = '{b}'").collect()} == {(float(i), float(j)): n for (i, j), n in want.items()}


def test_forest_reads_paths_off_tables():
    rng = np.random.default_rng(12)
    for p in (1, 2, 6):
        x = np.round(rng.normal(size=(2000, p)), 1)
        forest = anomaly.Forest([anomaly._tree(x[rng.choice(2000, 256, replace=False)], rng, 8) for _ in range(20)], 256)
        total = sum(anomaly._walked(tree, x) for tree in forest.trees)
        assert np.array_equal(forest.scores(x), 2.0 ** (-total / 20 / anomaly.expected_path(256)))
        assert p == 6 or all(t is not None for t in forest.tables[1])


def test_kmeans_sums_weigh_equal_rows_as_one():
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(700, 3)), rng.integers(1, 5, 700)
    centres = [rng.normal(size=(k, 3)) for k in (2, 2, 3)]
    every = np.repeat(x, w, axis=0)
    for got, c in zip(models._sums(x, w.astype(float), centres), centres, strict=True):
        d = ((every[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        want = [[(own == j).sum(), d[own == j, j].sum(), *every[own == j].sum(axis=0)] for j in range(len(c))]
        assert got == pytest.approx(np.array(want))


def test_kmeans_scores(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (5, 0), (0, 6))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = {r.k: r for r in models.kmeans(df, ks=range(2, 5), starts=3).collect()}
    assert got[3].best and got[3].best_davies_bouldin and got[3].elbow and sorted(got[3].sizes) == [60, 60, 60] and got[3].balance == 1.0
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = np.repeat([0, 1, 2], 60)
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    s = []
    for i in range(180):
        mean = [d[i, own == c].sum() / (60 - (own[i] == c)) for c in range(3)]
        a, b = mean[own[i]], min(m for c, m in enumerate(mean) if c != own[i])
        s.append((b - a) / max(a, b))
    assert got[3].silhouette == pytest.approx(np.mean(s), rel=1e-6)
    centre = np.array([z[own == c].mean(axis=0) for c in range(3)])
    spread = [np.sqrt(((z[own == c] - centre[c]) ** 2).sum(axis=1)).mean() for c in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(3) if j != i) for i in range(3)])
    assert got[3].davies_bouldin == pytest.approx(db, rel=1e-6)
    assert models.kmeans(df.limit(10)).count() == 0
    parts = models.pca(df)
    assert models.pca_summary(parts).first().for_99 == 2 and models.pca_top_features(parts).count() == 4


def test_configurations(tmp_path):
    c = recipes.options(preset="aggressive", knn_neighbors=9)
    assert tuple(c[k] for k in ("missing_strategy", "knn_neighbors", "outlier_treatment", "category_threshold", "mice_max_iter")) == ("knn", 9, "remove", 0.3, 10)
    for name in ("c.json", "c.yaml"):
        recipes.save_options(str(tmp_path / name), preset="minimal", outlier_threshold=3.0)
        got = recipes.options(str(tmp_path / name), missing_strategy="mean")
        assert (got["missing_strategy"], got["outlier_threshold"], got["outlier_detection"]) == ("mean", 3.0, False)
    assert recipes.conflicts({"missing_strategy": "drop", "outlier_treatment": "impute"})["warnings"]
    assert not recipes.conflicts({"plugins": ["nothing"]})["valid"]
    with pytest.raises(ValueError):
        recipes.options(preset="nothing")
    with pytest.raises(ValueError, match="no option"):
        recipes.options(missing_stratagem="mean")
    assert set(recipes.presets()) >= {"minimal", "standard", "aggressive", "ml_ready", "production"}


def test_runs_with_plugins_and_hooks(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (1, 1.0, "x"), (2, None, "y"), (3, 50.0, None), (4, 2.0, "yes")], "k long, v double, s string")
    seen, hooks = [], recipes.Hooks()
    for e in recipes.Event:
        hooks.subscribe(e, lambda data, e=e: seen.append((e, data)))
    recipes.PLUGINS["small"] = recipes.value_range("v", 0, 10)
    recipes.PLUGINS["zero"] = recipes.imputer(lambda d, c: F.lit(0.0), ["v"])
    recipes.PLUGINS["odd"] = recipes.outlier_detector(lambda d, c: F.col(c) > 1.5, ["v"], keep=True)
    out = recipes.clean(df, hooks=hooks, missing_strategy="none", outlier_detection=False, optimize_dtypes=False, plugins=["zero", "small", "odd"])
    assert {(r.k, r.v, r.v_outlier) for r in out.collect()} == {(1, 1.0, False), (2, 0.0, False), (4, 2.0, True)} and out.count() == 3
    assert [e for e, _ in seen][0] is recipes.Event.STARTED and [e for e, _ in seen][-1] is recipes.Event.COMPLETED
    with pytest.raises(KeyError):
        recipes.clean(df, missing_strategy="none", outlier_detection=False, optimize_dtypes=False, encoding_method="nothing")
    left = recipes.clean(df, hooks=hooks, continue_on_error=True, missing_strategy="none", outlier_detection=False, optimize_dtypes=False, encoding_method="nothing")
    assert left.count() == 4 and any(e is recipes.Event.RECOVERED for e, _ in seen)
    ml = recipes.clean(df, "ml_ready", encoding_method="label", missing_strategy="median", outlier_method="iqr")
    assert ml.columns == df.columns and abs(ml.agg(F.avg("v")).first()[0]) < 1e-9
    live = recipes.live_clean(df, drop=["s", "none"], missing="mode")
    assert sorted(r.v for r in live.collect()) == pytest.approx([1.0, 2.0, 53 / 3, 50.0])
    assert recipes.clean(df.limit(0), "standard").count() == 0


def test_steps_make_a_recipe_and_give_way(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 4.0, "b"), (3, 6.0, None)], "k long, v double, s string")
    made = recipes.distinct() + recipes.filled("mean", {"s": "mode"}) + recipes.without(["k"])
    assert [name for name, _, _ in made.steps] == ["duplicates", "missing", "columns"]
    assert sorted(map(tuple, made(df).collect()), key=str) == [(4.0, "b"), (5.0, "a"), (6.0, "a")]
    # a strategy that can't be planned gives way to median and mode
    seen, hooks = [], recipes.Hooks()
    hooks.subscribe(recipes.Event.RECOVERED, seen.append)
    out = recipes.followed(df, recipes.distinct() + recipes.filled("nothing"), hooks, continue_on_error=True)
    assert {r.v for r in out.collect()} == {4.0, 5.0, 6.0} and seen[0]["step"] == "missing"
    with pytest.raises(ValueError):
        recipes.followed(df, recipes.filled("nothing"), hooks)


def test_strategies_in_order(spark):
    df = spark.createDataFrame([(1, None, 1.0, "a"), (2, 4.0, None, "b"), (3, 6.0, 3.0, None), (4, 8.0, None, "a")], "k long, a double, b double, s string")
    got = cleaning.fill_by_strategy(df, "median", {"s": "drop", "b": "forward"}, order=["k"]).orderBy("k").collect()
    assert [(r.k, r.a, r.b, r.s) for r in got] == [(1, 6.0, 1.0, "a"), (2, 4.0, 1.0, "b"), (4, 8.0, 3.0, "a")]
    got = cleaning.fill_by_strategy(df, "mode", values={"b": 9.0}).orderBy("k").collect()
    assert [(r.a, r.b, r.s) for r in got] == [(4.0, 1.0, "a"), (4.0, 9.0, "b"), (6.0, 3.0, "a"), (8.0, 9.0, "a")]
    with pytest.raises(ValueError):
        cleaning.fill_by_strategy(df, "forward")
    types = cleaning.repair_types(spark.createDataFrame([("on", "01-02-24"), ("OFF", "03-04-24")], "b string, d string"))
    assert dict(types.dtypes) == {"b": "boolean", "d": "timestamp"} and [r.b for r in types.collect()] == [True, False]
    words = cleaning.clean_text(spark.createDataFrame([("Running, the classes and jumped boxes!",)], "t string"), "t", stopwords=["the"], stem=True).first().t
    assert words == "run class and jump box"


def test_amounts_and_zones(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    orders = frame([(1, 1, "2024-03-31 00:00:00", 0.004), (2, 1, "2024-03-31 00:00:00", 0.004), (3, 1, "2024-02-29 12:00:00", 1e17)], "order_id long, customer_id long, order_date string, total_amount double").withColumn("order_date", F.col("order_date").cast("timestamp"))
    customers = frame([(1, "2024-03-01 00:00:00", "web")], "customer_id long, acquisition_date string, acquisition_channel string").withColumn("acquisition_date", F.col("acquisition_date").cast("timestamp"))
    star = Star(orders, customers, frame([(1, 1.0, 1.0)], "product_id long, cost double, price double"), frame([("web", 0.004), ("web", 0.004)], "channel string, spend_amount double"))
    assert kpi.ad_spend(star).first().spend_amount == pytest.approx(0.008)
    assert {r.revenue for r in kpi.revenue(star, "monthly").collect()} == {1e17, 0.008}
    assert kpi.break_even(star, 99).first().break_even_units is None
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            o = frame([(1, 1, "2024-03-31 00:00:00", 1.0), (2, 1, "2024-02-29 12:00:00", 1.0)], "order_id long, customer_id long, order_date string, total_amount double")
            c = frame([(1, "2024-03-01 00:00:00", "web")], "customer_id long, acquisition_date string, acquisition_channel string")
            got = {r.period for r in kpi.retention(Star(o, c, star.products, star.marketing)).collect()}
            assert got == {1, -1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quality_thresholds_and_quirks(spark):
    scores = spark.createDataFrame([(84.9, 75.0, 79.0, 69.0, 95.0, 100.0, 86.0)], "score double, completeness double, uniqueness double, consistency double, validity double, accuracy double, timeliness double")
    got = {r.dimension: r.severity for r in quality.alerts(scores).collect()}
    assert got == {"score": "low", "completeness": "critical", "uniqueness": "low", "consistency": "critical", "timeliness": "low"}
    df = spark.createDataFrame([(1.0, -2.0, "x"), (2.0, 3.0, None)], "average double, price double, s string")
    s = quality.eda_score(df).first()
    assert (s.accuracy, s.consistency, s.timeliness, s.grade) == (0.0, 50.0, 100.0, "Good")
    assert [r.dimension for r in quality.eda_priorities(quality.eda_score(df)).orderBy("rank").collect()] == ["accuracy", "consistency", "completeness"]
    inf = spark.createDataFrame([(float("inf"), 1), (None, 1)], "v double, k int")
    c = quality.cleaning_score(inf).first()
    assert c.validity == 75.0 and c.uniqueness == 50.0 and c.infinite_values == 1
    assert quality.chart_score(inf).first().validity == 50.0
    with pytest.raises(ValueError):
        quality.validate(df.limit(0))
    kinds = [r.kind for r in insights.insights(df, normality=True).orderBy("rank").collect()]
    assert kinds[0] == "small" and "quality_good" in kinds


def test_charts_and_series(spark):
    df = spark.range(5000).select(F.col("id").alias("x"), F.sin(F.col("id") / 50).alias("y"), F.lit("a").alias("g"))
    got = charts.largest_triangles(df, "x", "y", 60).orderBy("x").collect()
    assert len(got) == 60 and got[0].x == 0 and got[-1].x == 4999 and max(r.y for r in got) > 0.999
    dens = charts.density(df, "y", "g", points=50).collect()
    assert sum(r.density for r in dens) * 2 / 49 == pytest.approx(1, abs=0.15)
    assert charts.density(df.limit(0), "y").count() == 0
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("t"), (F.col("id") + F.col("id") % 12).cast("double").alias("v"))
    s = timeseries.strengths(days, "t", "v").first()
    assert s.frequency == "daily" and s.period == 12 and 0.5 < s.trend < 1.1
    assert timeseries.analysis(days, "t").first().trend == "increasing" and timeseries.forecast(days, "t", "v", 3).count() == 3


def test_scalars(spark):
    one = spark.createDataFrame([("Hello big_world", "4111 1111 1111 1111", 1536, "2024-02-29", "<b>x'; --y</b>")], "s string, c string, n long, d string, h string")
    r = one.select(scalars.camel("s").alias("camel"), scalars.title("s").alias("title"), scalars.is_card("c").alias("card"), scalars.size_text("n").alias("size"), scalars.parse_date("d").cast("date").cast("string").alias("date"), scalars.sanitized("h").alias("clean"), scalars.percent_text(F.lit(0.455)).alias("percent"), scalars.number_text(F.lit(1234567.891)).alias("number"), scalars.age(F.lit("2000-03-01").cast("date"), F.lit("2024-02-29").cast("date")).alias("age"), scalars.is_url(F.lit("https://x.org/a")).alias("url"), scalars.is_phone(F.lit("+44 20 7946 0958")).alias("phone"), scalars.has_extension(F.lit("A.CSV"), [".csv"]).alias("ext"), scalars.is_decimal(F.lit("1.25"), 2).alias("dec"), scalars.slug(F.lit(" A b, c! ")).alias("slug")).first()
    assert tuple(r) == ("helloBigWorld", "Hello Big_world", True, "1.50 KB", "2024-02-29", "x y", "45.5%", "1,234,567.89", 23, True, True, True, True, "a-b-c")
