import json
import math
import random

import numpy as np
import pandas as pd
import pytest

from brinework.operators import charts
from brinework.sources import files


def journeys(seed=3, n=1500):
    rng = random.Random(seed)
    # one user has a third of all rows
    return [(rng.choice([1, 1, 1, None, *range(2, 8)]), rng.randint(0, 400), rng.choice(["a", "b", "c", None])) for _ in range(n)]


@pytest.mark.parametrize("range_rows", [10**6, 100, 37])
def test_flows_as_a_loop(spark, range_rows):
    rows = journeys()
    df = spark.createDataFrame([(u, at, s, 0) for u, at, s in rows], "_by int, _at int, _s string, _range int").repartition(5)
    want: dict = {}
    for user in {u for u, _, _ in rows if u is not None}:
        own = [s for _, _, s in sorted(((0, at, s or "") for u, at, s in rows if u == user))]
        for i in range(1, len(own)):
            key = (min(i, 4), own[i - 1], own[i])
            want[key] = want.get(key, 0) + 1
    got = {(r["level"], r["source"] or "", r["target"] or ""): r["n"] for r in charts.flows(df, "_by", ["_at"], "_s", levels=4, range_rows=range_rows).collect()}
    assert got == want
    assert charts.flows(df.limit(0), "_by", ["_at"], "_s").count() == 0


def test_hexagons_hold_the_nearest_centre(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=400), rng.gamma(2, 5, size=400)
    df = spark.createDataFrame([*zip(map(float, x), map(float, y), range(400), strict=True), (None, 1.0, 7), (1.0, None, 7)], "x double, y double, v int")
    got = charts.hexagons(df, "x", "y", cells=9, value="v").collect()
    w, h = (x.max() - x.min()) / 9, (y.max() - y.min()) / 5
    centres = np.array([(x.min() + (i + s) * w, y.min() + (j + s) * h) for i in range(-1, 11) for j in range(-1, 7) for s in (0, 0.5)])
    far = ((x[:, None] - centres[:, 0]) / w) ** 2 + 3 * ((y[:, None] - centres[:, 1]) / h) ** 2
    own = far.argmin(axis=1)
    want = {(round(centres[c, 0], 6), round(centres[c, 1], 6)): (int((own == c).sum()), float(np.flatnonzero(own == c).mean())) for c in set(own)}
    assert {(round(r["x"], 6), round(r["y"], 6)): (r["n"], pytest.approx(r["mean"])) for r in got} == want
    flat = charts.hexagons(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, y double"), "x", "y").collect()
    assert [tuple(r) for r in flat] == [(1.0, 2.0, 2)]


def test_normal_quantiles(spark):
    v = np.random.default_rng(2).normal(10, 3, 5000)
    got = charts.normal_quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v", points=50).orderBy("i").collect()
    assert [r["value"] for r in got] == pytest.approx(np.quantile(v, (np.arange(50) + 0.5) / 50))
    assert np.abs(np.array([r["value"] - r["expected"] for r in got])).max() < 0.5
    assert charts.normal_quantiles(spark.createDataFrame([(1.0,)], "v double"), "v").count() == 0


def test_json_by_columns_as_pandas_writes_it(spark, tmp_path):
    one = pd.DataFrame({"id": [1, 2, 3], "x": [0.5, None, 1.0], "name": ["ä", None, 'q"'], "ok": [True, False, True], "odd `name`": [1, 2, 3]}, index=[5, 6, 7])
    two = pd.DataFrame({"id": [4], "x": [2.25], "name": ["z"], "extra": [[1, 2]]}, index=[5])
    one.to_json(tmp_path / "one.json")
    two.to_json(tmp_path / "two.json")
    got = files.read_json_columns(spark, str(tmp_path), index="label")
    assert dict(got.dtypes) == {"label": "string", "id": "bigint", "x": "double", "name": "string", "ok": "boolean", "odd `name`": "bigint", "extra": "string"}
    rows = {r["id"]: r.asDict() for r in got.collect()}
    for frame in (one, two):
        for label, r in frame.iterrows():
            found = rows[r["id"]]
            assert found["label"] == str(label)
            for c in set(found) - {"label"}:
                want = r.get(c)
                want = None if want is None or isinstance(want, float) and math.isnan(want) else json.dumps(want, separators=(",", ":")) if isinstance(want, list) else want
                assert found[c] == want
    mixed = spark.createDataFrame([("f", '{"a": {"0": 1, "1": "x", "2": null}, "b": {"0": null}}'), ("g", "{}")], "file string, text string")
    assert {r["i"]: (r["a"], r["b"]) for r in files.json_columns(mixed, "i").collect()} == {"0": ("1", None), "1": ("x", None), "2": (None, None)}


def test_json_columns_of_even_files_stay_where_they_are(spark):
    even = spark.createDataFrame([("f", '{"a": {"1": 1, "0": 2}, "b": {"0": null, "1": "y"}}'), ("g", '{"a": {"7": 3}}')], "file string, text string")
    got = files.json_columns(even, "i")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan.lower() or "explode(arrays_zip" in plan
    assert {r["i"]: (r["a"], r["b"]) for r in got.collect()} == {"0": (2, None), "1": (1, "y"), "7": (3, None)}
