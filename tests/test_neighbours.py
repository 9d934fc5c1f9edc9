import random

import numpy as np
import pytest

from brinework.operators import neighbours


def brute(x: np.ndarray, k: int) -> np.ndarray:
    """Factors by all distances, each row's neighbours being all others up to its k-th distance."""
    n = len(x)
    k = min(k, n - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    near = d <= kth[:, None]
    np.fill_diagonal(d, 0)
    density = np.array([1 / (np.maximum(d[i, near[i]], kth[near[i]]).mean() + 1e-10) for i in range(n)])
    return np.array([density[near[i]].mean() / density[i] for i in range(n)])


@pytest.mark.parametrize("dims,kind", [(1, "number"), (2, "mixed"), (2, "grid"), (5, "number")])
def test_factors_as_brute_force(spark, monkeypatch, dims, kind):
    monkeypatch.setattr(neighbours, "CELL_POINTS", 20)
    rng = random.Random(dims)
    one = {
        "number": lambda: rng.gauss(0, 1) + rng.choice([0, 0, 20]),
        "grid": lambda: float(rng.randint(0, 9)),
        "mixed": lambda: rng.choice([rng.gauss(0, 3), float(rng.randint(-2, 2)), -0.0]),
    }[kind]
    x = np.array([[one() for _ in range(dims)] for _ in range(500)] + [[1000.0] * dims, [-1000.0] * dims])
    names = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *names]).repartition(5)
    got = {r["i"]: r["lof"] for r in neighbours.local_outlier_factor(df, names, k=7).collect()}
    assert len(got) == len(x)
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(brute(x, 7), rel=1e-6)


def test_factors_of_few_rows_and_missing_values(spark):
    schema = "i int, x double, lof double, _at string"
    df = spark.createDataFrame([(1, 0.0, 9.0, "a"), (2, 1.0, None, None), (3, 5.0, None, None), (4, None, None, None), (5, float("nan"), None, None), (6, float("inf"), None, None)], schema)
    got = {r["i"]: r["lof"] for r in neighbours.local_outlier_factor(df, ["x"], k=20).collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(brute(np.array([[0.0], [1.0], [5.0]]), 20), rel=1e-6)
    assert got[4] is got[5] is got[6] is None
    alone = neighbours.local_outlier_factor(df.where("i = 1"), ["x"]).collect()
    assert [(r["i"], r["lof"]) for r in alone] == [(1, None)]
    assert neighbours.local_outlier_factor(df.limit(0), ["x"]).count() == 0
    same = spark.createDataFrame([(i, 3.0) for i in range(50)], "i int, x double")
    assert {r["lof"] for r in neighbours.local_outlier_factor(same, ["x"], k=5).collect()} == {1.0}


def test_only_near_cells_are_asked():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 2))
    cells = neighbours.cells_of(x, 64, 5)
    own = cells.of(x)
    assert set(own) == set(range(64)) and np.bincount(own).max() < 120
    asked = cells.within(x, np.full(len(x), 0.01))
    assert all(c in a for c, a in zip(own, asked, strict=True)) and np.mean([len(a) for a in asked]) < 1.5
