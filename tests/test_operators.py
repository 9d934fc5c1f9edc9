"""Small fixtures of the cases the test tables do not have."""

import math
from datetime import date, datetime

import numpy as np
import pytest

from brinework.functions import special
from brinework.operators import anomaly, charts, cleaning, impute, insights, kpi, models, profile, quality, relational, hypothesis_tests, timeseries
from brinework.sources import catalog, files
from brinework.sources.star import Star
from brinework.streaming import ingest


def star(spark, orders=(), customers=(), products=(), marketing=(), touches=(), visits=()):
    return Star(
        spark.createDataFrame(list(orders), "order_id long, customer_id long, order_date timestamp_ntz, total_amount double, channel string, products array<struct<product_id: long, quantity: double>>"),
        spark.createDataFrame(list(customers), "customer_id long, acquisition_date timestamp_ntz, acquisition_channel string"),
        spark.createDataFrame(list(products), "product_id long, cost double, price double, category string, fixed_costs double"),
        spark.createDataFrame(list(marketing), "channel string, spend_amount double"),
        spark.createDataFrame(list(touches), "customer_id long, date timestamp_ntz, channel string, touch_id long"),
        spark.createDataFrame(list(visits), "channel string, visit_id long, customer_id long"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_star_contract(spark):
    s = star(spark)
    with pytest.raises(ValueError, match="orders lacks"):
        Star(s.orders.drop("order_id"), s.customers, s.products, s.marketing)
    text = s.orders.drop("order_date", "products").selectExpr("*", "'2024-01-05' order_date", "'[]' products")
    assert dict(Star(text, s.customers, s.products, s.marketing).orders.dtypes)["order_date"] == "timestamp"


def test_revenue_range_is_inclusive_at_midnight(spark):
    o = [(i, 1, datetime(2024, 1, d, h), 10.0, "a", None) for i, (d, h) in enumerate([(1, 0), (2, 23), (3, 0), (3, 10)])] + [(9, 1, None, 5.0, "a", None)]
    s = star(spark, o)
    assert rows(kpi.revenue(s, "daily", "2024-01-02", date(2024, 1, 3))) == [(date(2024, 1, 2), 10.0), (date(2024, 1, 3), 10.0)]
    with pytest.raises(ValueError):
        kpi.revenue(s, "hourly")


def test_null_groups_and_channels_without_customers(spark):
    s = star(spark, [(1, 1, datetime(2024, 1, 1), None, "a", None), (2, None, datetime(2024, 1, 1), 7.0, None, None), (3, 1, datetime(2024, 2, 1), 5.0, "c", None)], [(1, datetime(2024, 1, 1), "a"), (None, datetime(2024, 1, 1), "b")], [], [("a", 10.0), ("b", 4.0), (None, 3.0)])
    assert rows(kpi.cac(s)) == [("a", 10.0), ("b", 0.0)]
    assert rows(kpi.roas(s)) == [("a", 0.0, 10.0, 0.0), ("c", 5.0, None, None)]
    assert rows(kpi.new_vs_returning(s)) == [(1, 0, 1)]
    assert rows(kpi.ltv(s)) == [(date(2024, 1, 1), 12.0, 1, 12.0)]


def test_periods_before_acquisition_are_negative(spark):
    s = star(spark, [(1, 1, datetime(2024, 1, 9, 23), 1.0, "a", None), (2, 1, datetime(2024, 2, 15), 1.0, "a", None)], [(1, datetime(2024, 1, 10), "a")])
    assert rows(kpi.retention(s)) == [(date(2024, 1, 1), -1, 1), (date(2024, 1, 1), 1, 1)]


def test_churn_is_strict(spark):
    s = star(spark, [(1, 1, datetime(2024, 1, 1), 1.0, "a", None), (2, 2, datetime(2023, 12, 31, 23, 59), 1.0, "a", None)])
    assert kpi.churn_rate(s, "2024-03-31", 90).first()[0] == 0.5
    assert kpi.churn_rate(star(spark), "2024-03-31").first()[0] == 0.0


def test_margins(spark):
    lines = [(1, 2.0), (2, 1.0), (9, 1.0)]
    s = star(spark, [(1, 1, datetime(2024, 1, 1), 50.0, "a", lines)], [], [(1, 3.0, 5.0, "x", 100.0), (2, 4.0, 4.0, None, None)], [("a", 8.0)])
    assert rows(kpi.gross_margin(s)) == [(1, 10.0, 6.0, 4.0), (2, 4.0, 4.0, 0.0)]
    assert [tuple(r) for r in kpi.top_products(s, 1).collect()] == [(1, 10.0, "x")]
    assert kpi.net_margin(s).first()[0] == 50.0 - 7.0 - 8.0
    assert rows(kpi.break_even(s, 1)) == [(1, 50.0)] and rows(kpi.break_even(s, 2)) == [(2, None)] and rows(kpi.break_even(s, 3)) == [(3, None)]


def test_tied_touches(spark):
    t = datetime(2024, 1, 1)
    s = star(spark, touches=[(1, t, "b", 2), (1, t, "a", 1), (2, t, "c", 3)])
    assert rows(kpi.attribution(s)) == [(1, "a"), (2, "c")] and rows(kpi.attribution(s, "last_touch")) == [(1, "b"), (2, "c")]
    assert rows(kpi.attribution(s, "all")) == [(1, "a"), (1, "b"), (2, "c")]


def frame(spark):
    return spark.createDataFrame([(1.0, None, "x", None), (2.0, 4.0, "x", None), (2.0, 6.0, None, None), (2.0, 6.0, None, None), (100.0, 8.0, "y", None)], "a double, b double, c string, d string")


def test_overview_and_stats(spark):
    o = profile.overview(frame(spark)).first()
    assert (o.rows, o.missing_cells, o.columns_with_missing, o.columns_all_missing, o.duplicate_rows) == (5, 8, 3, 1, 1)
    s = {r.column: r for r in profile.numeric_stats(frame(spark)).collect()}
    assert (s["a"].mode, s["a"].outliers, s["b"].missing, s["b"].p50) == (2.0, 2, 1, 6.0)
    empty = profile.overview(frame(spark).limit(0)).first()
    assert (empty.rows, empty.missing_percent, empty.density_percent) == (0, 0.0, 0.0)


def test_pairs_without_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 6.0)], "a double, b double, c double")
    assert {(r.a, r.b): r.r for r in profile.pearson(df).collect()} == {("a", "b"): None, ("a", "c"): pytest.approx(1.0), ("b", "c"): None}
    assert {(r.a, r.b): r.r for r in profile.spearman(df).collect()}[("a", "b")] is None
    assert profile.kendall(df, ["a", "c"]).first().tau == pytest.approx(1.0)
    assert [r.kind for r in profile.constant_features(df).collect()] == ["constant"]


def test_fill_and_carry(spark):
    got = [tuple(r) for r in cleaning.fill(frame(spark)).orderBy("a", "b").collect()]
    assert got[0] == (1.0, 6.0, "x", "Unknown") and got[2][2] == "x"
    s = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, None), (5, 8.0), (6, None)], "i int, v double")
    assert [r.v for r in cleaning.carry(s, "v", ["i"]).orderBy("i").collect()] == [None, 5.0, 5.0, 5.0, 8.0, 8.0]
    assert [r.v for r in cleaning.carry(s, "v", ["i"], forward=False).orderBy("i").collect()] == [5.0, 5.0, 8.0, 8.0, 8.0, None]
    assert [r.v for r in cleaning.interpolate(s, "v", "i").orderBy("i").collect()] == [None, 5.0, 6.0, 7.0, 8.0, None]


def test_outlier_treatments(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 39)] + [(-500.0,), (900.0,)], "v double")
    assert cleaning.treat_outliers(df, ["v"], "cap").agg({"v": "min"}).first()[0] == 1.0
    assert cleaning.treat_outliers(df, ["v"], "remove").count() == 38
    assert sorted(r.v for r in cleaning.treat_outliers(df, ["v"], "impute", value=0.0).collect())[:2] == [0.0, 0.0]
    w = sorted(r.v for r in cleaning.winsorize(df, "v").collect())
    assert w[:3] == [2.0, 2.0, 2.0] and w[-3:] == [37.0, 37.0, 37.0]


def test_encoders_with_nulls_and_one_value(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, 5.0), ("b", 2.0)], "c string, t double")
    assert rows(cleaning.label_encode(df, "c")) == sorted([(1, 1.0), (0, 3.0), (None, 5.0), (1, 2.0)], key=str)
    assert rows(cleaning.one_hot(df, "c")) == sorted([(1.0, True), (3.0, False), (5.0, False), (2.0, True)], key=str)
    assert {r.c_target for r in cleaning.target_encode(df, "c", "t").collect()} == {1.5, 3.0, None}
    many = spark.createDataFrame([(str(i),) for i in range(11)], "c string")
    assert cleaning.one_hot(many, "c").columns == ["c"]
    assert cleaning.binary_encode(spark.createDataFrame([("x",)], "c string"), "c").columns == []


def test_type_repair(spark):
    df = spark.createDataFrame([("$1,200", "yes", "2024-01-05", "a"), ("3", "NO", "2024-02-06", "1"), (None, None, None, "b")], "n string, y string, d string, s string")
    got = cleaning.repair_types(df)
    assert dict(got.dtypes) == {"n": "double", "y": "boolean", "d": "timestamp", "s": "string"}
    assert got.first().n == 1200.0
    assert dict(cleaning.convert(df, "s", "int", "ignore").dtypes)["s"] == "string" and cleaning.convert(df, "s", "int").first().s is None


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 3, None), (2, 3, None)], "k int, o int, v string")
    assert cleaning.drop_duplicates(df).count() == 3
    assert rows(cleaning.drop_duplicates(df, ["k"], ["o"]).select("k", "o")) == [(1, 1), (2, 3)]
    assert rows(cleaning.drop_duplicates(df, ["k"], ["o"], "last").select("k", "v")) == [(1, "x"), (2, None)]
    assert cleaning.drop_duplicates(df, ["k"], keep="none").count() == 0


def test_hypothesis_tests_hypotheses(spark):
    two = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "a string, b string")
    r = hypothesis_tests.chi_square(two, "a", "b").first()
    expect = [(10, 30 * 40 / 65), (20, 30 * 25 / 65), (30, 35 * 40 / 65), (5, 35 * 25 / 65)]
    stat = sum((abs(o - e) - 0.5) ** 2 / e for o, e in expect)
    assert r.statistic == pytest.approx(stat) and r.p_value == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    g = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 7.0)], "g string, x double")
    assert hypothesis_tests.anova(g, "x", "g").first().statistic == pytest.approx(1.5 / (16 / 4) * 4)
    assert hypothesis_tests.kruskal(g, "x", "g").first().p_value < 1
    assert hypothesis_tests.anova(g.limit(2), "x", "g").first().statistic is None
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05) and special.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + b)) for a, b in x], "a double, b double, c double")
    assert {r.column: r.severity for r in models.vif(df).collect()}["c"] == "high"
    parts = models.pca(df).collect()
    assert sum(r.ratio for r in parts) == pytest.approx(1) and parts[2].ratio == pytest.approx(0, abs=1e-9)
    assert models.mutual_information(df, ["a", "b"], "c").count() == 2
    two = spark.createDataFrame([(float(i % 2 * 100 + i / 50), 0.0) for i in range(60)], "a double, b double")
    assert [r.k for r in models.kmeans(two, ["a"], range(2, 4)).where("best").collect()] == [2]


def test_series(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1 + i), float(i % 7 + i)) for i in range(28)], "t timestamp_ntz, v double")
    assert timeseries.trend(df, "t", "v").first().trend == "increasing"
    m = [r.average for r in timeseries.moving_average(df, "t", "v", 4).orderBy("day").collect()]
    v = [i % 7 + i for i in range(28)]
    assert m[2] == pytest.approx((v[0] / 2 + v[1] + v[2] + v[3] + v[4] / 2) / 4) and m[1] is None
    assert timeseries.adf(df, "t", "v").count() == 1 and timeseries.adf(df.limit(5), "t", "v").count() == 0
    p = timeseries.pacf(np.array([1.0, 2, 1, 3, 2, 4, 3, 5, 4, 6]), 3)
    assert p[0] == 1 and p[1] == pytest.approx(timeseries.acf(np.array([1.0, 2, 1, 3, 2, 4, 3, 5, 4, 6]), 1)[1])


def test_quality_and_insights(spark):
    assert quality.catalog_score(frame(spark)).first().score == pytest.approx(100 * (1 - 0.7 * 8 / 20 - 0.3 / 5))
    assert quality.eda_score(frame(spark)).first().consistency == 50.0
    assert {r.dimension for r in quality.alerts(quality.cleaning_score(frame(spark))).collect()} >= {"completeness"}
    assert ("all null", "d") in rows(quality.input_problems(frame(spark)))
    kinds = {r.kind for r in insights.insights(frame(spark)).collect()}
    assert {"missing_high", "duplicates", "small", "quality_fair"} <= kinds or {"missing_high", "duplicates", "small"} <= kinds
    assert quality.catalog_score(frame(spark).limit(0)).first().score == 0.0


def test_charts_of_constant_and_empty_columns(spark):
    one = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert rows(charts.histogram(one, "v")) == [(0, 5.0, 5.0, 2)]
    assert charts.histogram(one.limit(0), "v").count() == 0
    assert charts.regression_line(one.selectExpr("v x", "v y"), "x", "y").first().slope is None


def test_relational(spark):
    df = spark.createDataFrame([(1, "a_b"), (2, None), (3, "A%B")], "k int, s string")
    assert relational.filter_rows(df, [("s", "contains", "a")], keep=False).count() == 2
    assert rows(relational.search(df, "%", ["s"]).select("k")) == [(3,)] and rows(relational.search(df, "a_", ["s"]).select("k")) == [(1,)]
    assert rows(relational.split_column(df, "s", "_", ["x", "y"]).select("x", "y")) == sorted([("a", "b"), (None, None), ("A%B", None)], key=str)
    assert relational.page_count(df, 2) == (3, 2)


def test_files_catalog_and_stream(spark, tmp_path):
    df = frame(spark)
    for kind in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / f"x.{kind}")
        files.write(df.drop("d"), path, kind)
        assert files.read(spark, path, "jsonl" if kind == "json" else kind).count() == 5
    (tmp_path / "l.csv").write_bytes("n,v\né,1\n".encode("latin-1"))
    assert files.read(spark, str(tmp_path / "l.csv")).first().n == "é"
    assert files.file_hashes(spark, str(tmp_path / "l.csv")).count() == 1
    catalog.save_statistics(profile.numeric_stats(df).select("column", "mean"), str(tmp_path / "stats"), "one")
    catalog.save_statistics(profile.numeric_stats(df).select("column", "mean"), str(tmp_path / "stats"), "two")
    catalog.save_statistics(profile.numeric_stats(df).select("column", "mean"), str(tmp_path / "stats"), "one")
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 4
    catalog.log_run(spark, str(tmp_path / "log"), ("s", datetime(2024, 1, 1), datetime(2024, 1, 2), "ok", "{}", 5, 4, ["dedupe"]))
    assert catalog.history(spark, str(tmp_path / "log")).count() == 1
    spark.createDataFrame([(datetime(2024, 1, d), 1.0) for d in (1, 1, 2, 20)], "order_date timestamp_ntz, total_amount double").write.parquet(str(tmp_path / "in"))
    stream = ingest.landed(spark, str(tmp_path / "in"), "order_date timestamp_ntz, total_amount double")
    ingest.run_once(ingest.revenue_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert (date(2024, 1, 1), 2.0) in rows(spark.read.parquet(str(tmp_path / "out")))


def test_normality(spark):
    rng = np.random.default_rng(4)
    normal = spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "v double")
    skewed = spark.createDataFrame([(float(v),) for v in rng.exponential(size=400)], "v double")
    x = np.sort([r.v for r in normal.collect()])
    z = (x - x.mean()) / x.std(ddof=1)
    p = np.array([special.normal_cdf(v) for v in z])
    i = np.arange(1, 401)
    assert hypothesis_tests.anderson_normal(normal, "v").first().statistic == pytest.approx(-400 - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / 400, abs=1e-3)
    assert hypothesis_tests.anderson_normal(normal, "v").first().normal and not hypothesis_tests.anderson_normal(skewed, "v").first().normal
    assert hypothesis_tests.shapiro_francia(normal, "v").first().p_value > 0.01 > hypothesis_tests.shapiro_francia(skewed, "v").first().p_value
    assert hypothesis_tests.anderson_normal(normal.limit(0), "v").first().statistic is None


def test_isolation_forest(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(300, 2))] + [(50.0, -50.0), (None, 1.0)]
    got = anomaly.flags(spark.createDataFrame(rows, "a double, b double"), contamination=0.02)
    top = got.orderBy("anomaly", ascending=False).first()
    assert top.a == 50.0 and top.is_anomaly and got.where("a is null").first().anomaly is None


def test_model_imputation(spark):
    rows = [(float(i), 2.0 * i + 1) for i in range(40)] + [(10.5, None), (None, 21.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    near = {(r.a, r.b) for r in impute.knn(df, ["a", "b"], k=2).collect()}
    assert (10.5, 22.0) in near and any(b == 21.0 and abs(a - 10) < 1.1 for a, b in near)
    chained = impute.mice(df, ["a", "b"])
    assert chained.where("a = 10.5").first().b == pytest.approx(22.0, abs=0.01) and chained.where("b = 21").orderBy("a").first().a == pytest.approx(10.0, abs=0.01)


def test_knn_searches_all_rows(spark):
    # every row of the even numbers is a donor: far more than a sample would hold
    df = spark.range(12_000).selectExpr("id * 2.0D AS a", "id * 4.0D AS b").union(spark.range(40).selectExpr("id * 600 + 1.0D", "CAST(NULL AS DOUBLE)"))
    got = {r.a: r.b for r in impute.knn(df, ["a", "b"], k=2).where("a % 2 = 1").collect()}
    assert got == {i * 600 + 1.0: i * 1200 + 2.0 for i in range(40)}


def test_knn_in_blocks_as_by_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    x[rng.random(x.shape) < 0.25] = np.nan
    x = np.vstack([x, x[:30], np.full((2, 3), np.nan)])
    want = x.copy()
    for i in range(len(x)):
        for j in np.flatnonzero(np.isnan(x[i])):
            both = ~np.isnan(x) & ~np.isnan(x[i])
            n = both.sum(axis=1)
            far = np.where(both, x - x[i], 0.0) ** 2
            ok = np.flatnonzero((n > 0) & ~np.isnan(x[:, j]))
            near = ok[np.argsort(far[ok].sum(axis=1) * 3 / n[ok], kind="stable")][:4]
            want[i, j] = x[near, j].mean() if len(near) else np.nanmean(x[:, j])
    monkeypatch.setattr(impute, "DONORS_A_TASK", 40)
    monkeypatch.setattr(impute, "ROWS_A_TASK", 25)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    got = impute.knn(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], k=4).orderBy("id").collect()
    assert np.allclose([[r.a, r.b, r.c] for r in got], want)
