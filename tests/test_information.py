"""Information by nearest rows against numpy, with ties, copies, small classes and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinework.operators import information
from brinework.operators.information import nearest_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def under(d, *at):
    return max(0.0, d - (d + sum(map(abs, at))) * 8e-15)


def of_classes(x, y, k):
    rows = [(a, b) for a, b in zip(x, y) if sum(c == b for c in y) > 1]
    x, y = np.array([a for a, _ in rows]), [b for _, b in rows]
    total = psi(len(rows))
    for i, (a, b) in enumerate(rows):
        own = sorted(abs(x[j] - a) for j in range(len(rows)) if y[j] == b and j != i)
        near = min(k, len(own))
        r = under(own[near - 1], a)
        m = int(((x >= a - r) & (x <= a + r)).sum())
        total += (psi(near) - psi(len(own) + 1) - psi(m)) / len(rows)
    return max(0.0, total)


def of_numbers(x, y, k):
    x, y = (np.array(v, dtype=float) / (np.std(v) or 1.0) for v in (x, y))
    n, total = len(x), psi(len(x)) + psi(k)
    for i in range(n):
        d = np.maximum(abs(x - x[i]), abs(y - y[i]))
        r = under(np.sort(np.delete(d, i))[k - 1], x[i], y[i])
        total -= sum(psi(int(((v >= v[i] - r) & (v <= v[i] + r)).sum())) for v in (x, y)) / n
    return max(0.0, total)


def rows_of(rng, n):
    x = rng.normal(size=n)
    label = np.where(rng.random(n) < 0.1, "b", np.where(x > 0, "a", "c"))
    return [(float(a), float(a + 0.3 * e), float(round(e, 1)), str(c)) for a, e, c in zip(x, rng.normal(size=n), label)]


def test_digamma(spark):
    got = spark.range(1, 300).select(information.digamma(F.col("id"))).collect()
    assert max(abs(r[0] - psi(i)) for i, r in enumerate(got, 1)) < 1e-11


@pytest.mark.parametrize("block", [8, 4096])
def test_classes_as_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(information, "BLOCK", block)
    rows = rows_of(np.random.default_rng(1), 300) + [(0.5, 0.5, 0.5, "single"), (1.0, 1.0, 1.0, "pair"), (3.0, 3.0, 3.0, "pair")] + [(0.25, 0.25, 0.2, "a")] * 40
    df = spark.createDataFrame(rows, "x double, z double, t double, y string")
    got = {r["feature"]: r for r in nearest_information(df, ["x", "z", "t"], "y").collect()}
    for i, c in enumerate("xzt"):
        assert got[c]["information"] == pytest.approx(of_classes([r[i] for r in rows], [r[3] for r in rows], 3), abs=1e-9)
    assert got["x"]["information"] > got["z"]["information"] > got["t"]["information"]
    assert got["x"]["importance"] == 1.0 and got["x"]["band"] == "high" and got["t"]["band"] == "low"


def test_numbers_as_numpy(spark):
    rows = rows_of(np.random.default_rng(2), 400) + [(0.25, 0.5, 0.2, "a")] * 30
    df = spark.createDataFrame(rows, "x double, z double, t double, y string")
    got = {r["feature"]: r for r in nearest_information(df, ["x", "t"], "z").collect()}
    for i, c in ((0, "x"), (2, "t")):
        assert got[c]["information"] == pytest.approx(of_numbers([r[i] for r in rows], [r[1] for r in rows], 3), abs=1e-9)
    assert got["x"]["importance"] == 1.0


def test_two_thousand_rows_as_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    y = x * x + 0.1 * rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = nearest_information(df, ["x"], "y").first()["information"]
    assert got == pytest.approx(of_numbers(x, y, 3), abs=1e-9) and got > 1


def test_nulls_and_little(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, 2.0, "a"), (None, 3.0, "b"), (float("nan"), 1.0, "b"), (4.0, 4.0, None), (5.0, 5.0, None)], "x double, z double, y string")
    want = of_classes([2.0, 4.0, 5.0], ["a", "", ""], 3)
    assert [r["information"] for r in nearest_information(df, ["x", "z"], "y").collect()] == pytest.approx([want] * 2)
    empty = df.where("false")
    assert [tuple(r) for r in nearest_information(empty, ["x"], "y").collect()] == [("x", None, 0.0, "low")]
    assert [tuple(r) for r in nearest_information(empty, ["x"], "z").collect()] == [("x", None, 0.0, "low")]
    assert nearest_information(df, [], "y").count() == 0
    one = spark.createDataFrame([(float(i), 7.0) for i in range(30)], "y double, x double")
    assert nearest_information(one, ["x"], "y").first()["information"] == pytest.approx(0.0, abs=1e-9)
