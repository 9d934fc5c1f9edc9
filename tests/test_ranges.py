import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinework.operators import cleaning, hypothesis_tests, ranges, ranks


def brute_carry(rows, forward):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    last, out = None, []
    for a, b, v in rows if forward else reversed(rows):
        last = v if v is not None else last
        out.append((a, b, last))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("seed, known, step", [(1, 0.3, 40), (2, 0.01, 7), (3, 0.0, 25), (4, 1.0, 1), (5, 0.02, 10**6)])
def test_carry_over_all_rows(spark, seed, known, step, forward):
    draw = random.Random(seed)
    rows = [(draw.choice([None, *range(20)]), i, draw.randrange(100) if draw.random() < known else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(5)
    got = cleaning.carry(df, "v", ["a", "b"], forward=forward, range_rows=step)
    assert got.columns == ["a", "b", "v"] and sorted(map(tuple, got.collect()), key=str) == brute_carry(rows, forward)


@pytest.mark.parametrize("step", [5, 60, 10**6])
def test_interpolate_over_all_rows(spark, step):
    draw = random.Random(step)
    rows = [(i * i, float(draw.randrange(50)) if draw.random() < 0.1 else None) for i in range(200)]
    got = {r.x: r.v for r in cleaning.interpolate(spark.createDataFrame(rows, "x long, v double"), "v", "x", range_rows=step).collect()}
    known = [r for r in rows if r[1] is not None]
    for x, v in rows:
        low, high = [k for k in known if k[0] <= x], [k for k in known if k[0] >= x]
        want = v if v is not None else low[-1][1] + (high[0][1] - low[-1][1]) * (x - low[-1][0]) / (high[0][0] - low[-1][0]) if low and high else None
        assert got[x] == pytest.approx(want) if want is not None else got[x] is None


def test_text_orders_ties_and_empty(spark):
    rows = [("é", 1), ("a", None), (None, 5), ("z" * 50, None), ("B", None)]
    got = dict(map(tuple, cleaning.carry(spark.createDataFrame(rows, "t string, v int"), "v", ["t"], range_rows=1).collect()))
    assert got == {None: 5, "B": 5, "a": 5, "z" * 50: 5, "é": 1}
    empty = spark.createDataFrame([], "t string, v int, _range int, _known int")
    assert cleaning.carry(empty, "v", ["t"]).columns == ["t", "v", "_range", "_known"] and cleaning.carry(empty, "v", ["t"]).count() == 0


@pytest.mark.parametrize("step", [3, 50, 10**6])
def test_places_of_text(spark, monkeypatch, step):
    monkeypatch.setattr(ranges.places, "__defaults__", (step,))
    values = [f"{i * 7919 % 1000}" + "é" * (i % 3) for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values + values[:50]] + [(None,)], "c string")
    got = cleaning.label_encode(df.withColumn("k", df.c), "c").collect()
    code = {v: i for i, v in enumerate(sorted(set(values), key=str.encode))}
    assert len(got) == 451 and all(r.c == (code[r.k] if r.k is not None else None) for r in got)


def test_no_window_over_all_rows(spark):
    df = spark.range(100).selectExpr("id", "if(id % 3 = 0, id, null) as v")
    plan = cleaning.carry(df, "v", ["id"], range_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and plan.count("Window") == 2  # one by ranges, one over a row for each range


@pytest.mark.parametrize("kind", ["double", "bigint", "date", "timestamp", "timestamp_ntz", "decimal(20,3)", "string"])
def test_ranges_keep_the_order_and_equal_rows(spark, kind):
    """Few different first values, nulls, NaN, infinities and zeros of both signs, so splitters have equal ones."""
    draw = random.Random(kind)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0] if kind == "double" else [None]
    rows = [(draw.choice([*odd, *map(float, range(-3, 4))]), draw.choice([None, *range(30)])) for _ in range(2000)]
    make = {"date": "date_add(date'2020-01-01', int(a))", "timestamp": "timestamp_micros(bigint(a) * 250000)", "timestamp_ntz": "cast(timestamp_micros(bigint(a) * 250000) as timestamp_ntz)"}.get(kind, f"cast(a as {kind})")
    if kind == "bigint":  # apart by less than doubles can tell
        make = "9007199254740993 + cast(a as bigint)"
    df = spark.createDataFrame(rows, "a double, b int").selectExpr(f"{make} as a", "b").repartition(3)
    ranged, name, n = ranges.dealt(df, ["a", "b"], 20)
    got = ranged.groupBy("a", "b").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy("a", "b").collect()
    assert n == 100 and all(r.lo == r.hi for r in got)
    assert [r.lo for r in got] == sorted(r.lo for r in got) and len({r.lo for r in got}) > 20


def test_backward_frames_do_not_start_anew_for_every_row(spark):
    """A frame that ends with its partition costs a partition's square."""
    df = spark.range(100).selectExpr("id", "id % 3 as k", "if(id % 3 = 0, id, null) as v")
    for got in (
        cleaning.carry(df, "v", ["id"], forward=False, range_rows=10), cleaning.carry(df, "v", ["id"], ["k"], forward=False), cleaning.carry_both(df, "v", "w", ["id"], range_rows=10),
        cleaning.interpolate(df, "v", "id", range_rows=10), cleaning.interpolate(df, "v", "id", ["k"]),
    ):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "_first" not in line]
        assert windows and not any("unboundedfollowing" in line.lower() for line in windows)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_interpolate_takes_the_value_of_an_equal_row(spark, by):
    rows = [(1, x, v) for x, v in [(0, 1.0), (2, None), (2, 5.0), (2, None), (4, 9.0), (9, None)]]
    got = cleaning.interpolate(spark.createDataFrame(rows, "k int, x int, v double"), "v", "x", by, range_rows=1).orderBy("x", "v").collect()
    assert [(r.x, r.v) for r in got] == [(0, 1.0), (2, 5.0), (2, 5.0), (2, 5.0), (4, 9.0), (9, None)]


def test_carry_both_is_both_carries(spark):
    draw = random.Random(9)
    rows = [(draw.choice([None, *range(20)]), i, draw.randrange(100) if draw.random() < 0.05 else None) for i in range(300)]
    got = cleaning.carry_both(spark.createDataFrame(rows, "a int, b int, v int").repartition(4), "v", "w", ["a", "b"], range_rows=11)
    assert sorted(map(tuple, got.select("a", "b", "v").collect()), key=str) == brute_carry(rows, True)
    assert sorted(map(tuple, got.select("a", "b", "w").collect()), key=str) == brute_carry(rows, False)


def test_group_medians(spark, monkeypatch):
    rng = np.random.default_rng(5)
    g = rng.choice(["a", "b", "c", "d"], 3000, p=[0.9, 0.08, 0.019, 0.001])
    rows = [(str(k), float(v)) for k, v in zip(g, rng.integers(0, 1000, 3000) / 4, strict=True)] + [("e", 2.0), ("e", 5.0), ("f", 1.5), ("g", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {k: float(np.median([x for h, x in rows if h == k and x is not None])) for k in "abcdef" if any(h == k for h, _ in rows)}
    for accuracy, few in ((10_000, 10_000), (50, 10_000), (50, 2)):  # all within, brackets, many groups
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        monkeypatch.setattr(ranks, "FEW_GROUPS", few)
        assert dict(map(tuple, ranks.group_medians(df, "x", "g").collect())) == want
    assert ranks.group_medians(df.limit(0), "x", "g").count() == 0


def test_levene_ranks_only_brackets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "exact_quantiles", None)
    monkeypatch.setattr(hypothesis_tests, "exact_quantiles", None, raising=False)
    df = spark.createDataFrame([("ab"[i % 2], float(i * (1 + i % 2))) for i in range(40)], "g string, x double")
    x = [[v for k, v in map(tuple, df.collect()) if k == h] for h in "ab"]
    d = [np.abs(np.array(v) - np.median(v)) for v in x]
    between = sum(len(v) * (v.mean() - np.concatenate(d).mean()) ** 2 for v in d)
    assert abs(hypothesis_tests.levene(df, "x", "g").first().statistic - between / (sum(((v - v.mean()) ** 2).sum() for v in d) / 38)) < 1e-9
