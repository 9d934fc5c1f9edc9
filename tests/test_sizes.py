"""What a task holds, and how often a table is gone through, must not depend on the size of the table."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from brinework.operators import cleaning, impute, models, profile, recipes


def test_whole_rows_are_grouped_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(cleaning.spread, "__defaults__", (100,))
    df = spark.range(3000).selectExpr("id % 1500 as a", "if(id % 7 = 0, null, double(id % 1500)) as b", "string(id % 2) as c").repartition(3)
    once = cleaning.drop_duplicates(df)
    assert once.rdd.getNumPartitions() == 30 and max(once.rdd.glom().map(len).collect()) < 200
    assert sorted(once.collect(), key=str) == sorted(df.distinct().collect(), key=str)
    assert cleaning.drop_duplicates(df, keep="none").count() == df.groupBy("a", "b", "c").count().where("count = 1").count()
    # the grouping of the same columns after it does not shuffle rows again
    plan = profile.overview(once)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and profile.overview(once).first()["duplicate_rows"] == 0


def test_a_small_table_is_left_as_it_is(spark):
    df = spark.range(50).selectExpr("id % 5 as a")
    assert "REPARTITION_BY_NUM" not in cleaning.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString() and cleaning.drop_duplicates(df).count() == 5


def test_duplicates_are_dropped_once_for_all_statistics(spark, tmp_path):
    """The steps after it take some ten statistics each; they read what is kept, and nothing stays kept."""
    spark.range(2000).selectExpr("id % 700 as a", "if(id % 7 = 0, null, double(id % 700)) as b", "string(id % 2) as c").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = df.count()

    @F.udf("bigint")
    def met(a):
        seen.add(1)
        return a

    counted = df.withColumn("a", met("a"))
    out = recipes.clean(counted, "standard")
    assert rows <= seen.value <= 2 * rows  # one pass for what is kept, besides the count of rows
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert out.count() == 700 and recipes.live_clean(df).count() == 700
    plain = recipes.Recipe(tuple((name + "_", change, instead) for name, change, instead in recipes.recipe(recipes.options(preset="standard")).steps))
    assert sorted(map(str, out.collect())) == sorted(map(str, plain(df).collect()))


@pytest.mark.parametrize("cells", [600, 1 << 17])
def test_kmeans_goes_over_the_rows_a_few_times(spark, monkeypatch, cells):
    """Starts settle among cells that sum up all rows; the fits end among the rows."""
    monkeypatch.setattr(models, "CELLS", cells, raising=False)
    x = np.random.default_rng(6).uniform(size=(4000, 2)).round(3)
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    passes, sent = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: passes.append(1) or sent(self, value))
    got = models.kmeans(df, ks=range(3, 8, 2), starts=4).collect()
    assert len(passes) < 20
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for r in got:
        least = np.inf
        for start in range(12):
            c = z[np.random.default_rng(start).choice(len(z), r.k, replace=False)]
            for _ in range(300):
                d = ((z[:, None] - c[None]) ** 2).sum(axis=2)
                c = np.array([z[d.argmin(axis=1) == j].mean(axis=0) for j in range(r.k)])
            least = min(least, ((z[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
        assert sum(r.sizes) == 4000 and r.inertia == pytest.approx(least, rel=0.01)


def test_kmeans_cells_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "CELLS", 60)
    x = np.random.default_rng(2).normal(size=(3000, 3))
    x[:, 2] = x[:, 2] > 0.5
    df = spark.createDataFrame([(*r, 1 + i % 3) for i, r in enumerate(x.tolist())], "a double, b double, c double, w int")
    means, w = models._cells(df, ["a", "b", "c"], "w", x[:500], 3000)
    assert len(w) <= 60 and w.sum() == 6000
    assert (means * w[:, None]).sum(axis=0) == pytest.approx((x * (1 + np.arange(3000) % 3)[:, None]).sum(axis=0))
    assert set(means[:, 2]) == {0.0, 1.0}  # a column of few values is cut between them


def test_knn_donors_of_common_values(spark, monkeypatch):
    """Values with more donors than a range should hold keep the first of those that are alike; ties go by hash."""
    monkeypatch.setattr(impute, "DONORS_A_TASK", 25)
    rng = np.random.default_rng(9)
    x = np.column_stack([np.where(rng.random(700) < 0.4, 3.0, rng.integers(0, 60, 700)), rng.integers(0, 4, 700), rng.normal(size=700).round(2)])
    x[rng.random(x.shape) < 0.12] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    tie = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64(F.lit(42), "a", "b", "c")).collect()])
    want = x.copy()
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        both = ~np.isnan(x) & ~np.isnan(x[i])
        far = (np.where(both, x - x[i], 0.0) ** 2).sum(axis=1) * 3 / np.maximum(both.sum(axis=1), 1)
        for j in np.flatnonzero(np.isnan(x[i])):
            ok = np.flatnonzero(both.any(axis=1) & ~np.isnan(x[:, j]))
            near = ok[np.lexsort((tie[ok], far[ok]))][:5]
            want[i, j] = x[near, j].mean() if len(near) else np.nanmean(x[:, j])
    got = impute.knn(df, ["a", "b", "c"]).orderBy("id").collect()
    assert np.allclose([[r.a, r.b, r.c] for r in got], want)


def test_knn_looks_at_few_donors_where_one_column_says_little():
    """A column of few values that are far apart hides the nearest donors from those beside a row."""
    rng = np.random.default_rng(4)
    donors = pd.DataFrame({"_c0": rng.uniform(0, 1000, 60_000), "_c1": rng.integers(1, 51, 60_000) / 1.0, "_c2": 1.0, "tie": 1, "n": 1})
    rows = pd.DataFrame({"_q0": rng.uniform(100, 900, 30), "_q1": rng.integers(1, 51, 30) / 1.0, "_q2": np.nan, "bound": np.inf})
    got = impute._nearest(donors, rows, impute.Search([0, 1], 0, [2], []), 3, 5, bounds=True)
    for q in got.itertuples():
        far = ((q._1 - donors["_c0"]) ** 2 + (q._2 - donors["_c1"]) ** 2) * 3 / 2
        assert q.bound >= far.nsmallest(5).iloc[-1]
        assert (((q._1 - donors["_c0"]) ** 2 * 3 / 2) <= q.bound).sum() < 1100


def test_knn_keeps_the_first_alike_of_a_common_value():
    donors = pd.DataFrame({"_c0": 7.0, "_c1": np.arange(600) % 2 * 1.0, "_c2": np.arange(600) * 1.0, "tie": np.arange(600)[::-1], "n": 1})
    left = impute._first_alike(donors, impute.Search([0, 1], 0, [2], []), 5)
    assert sorted(left["_c2"]) == [float(i) for i in range(590, 600)]


def test_knn_goes_over_the_rows_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def met(a):
        seen.add(1)
        return a

    df = spark.range(3000).selectExpr("double(id) as a", "if(id % 5 = 0, null, double(id % 50)) as b").repartition(2)
    df = df.withColumn("a", met("a"))
    assert impute.knn(df, ["a", "b"]).agg(F.count("b")).first()[0] == 3000
    assert seen.value <= 6 * 3000


def test_kendall_makes_no_row_for_every_pair(spark, monkeypatch):
    """Rows are counted on the grids of all pairs where they are, and dealt once for each column of many values."""
    rng = np.random.default_rng(13)
    x = np.column_stack([rng.integers(0, 3, 500) / 1.0, rng.normal(size=500).round(1), rng.normal(size=500), rng.integers(0, 90, 500) / 1.0])
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    assert "Generate" not in profile.kendall(df)._jdf.queryExecution().optimizedPlan().toString()
    for parts, counted in ((256, 1_000_000), (4, 100)):
        monkeypatch.setattr(profile, "PARTS", parts)
        monkeypatch.setattr(profile, "COUNTED", counted)
        got = {(r.a, r.b): r.tau for r in profile.kendall(df).collect()}
        for (i, a), (j, b) in itertools.combinations(enumerate("abcd"), 2):
            u, v = x[~np.isnan(x[:, [i, j]]).any(axis=1)][:, [i, j]].T
            s, t = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
            assert got[a, b] == pytest.approx((s * t).sum() / np.sqrt((s * s).sum() * (t * t).sum()))
