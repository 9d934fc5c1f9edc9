import numpy as np
import pytest

from brinework.operators import predict

FEATURES = ["a", "b", "noise", "twin"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3)) * [1, 5, 2] + [1e4, 0, 3]
    y = 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=3000)
    kind = np.where(x[:, 1] > 2, "hi", np.where(x[:, 1] < -2, "lo", "mid"))
    rows = [(i, *map(float, r), float(r[2] * 2), float(v), str(k)) for i, (r, v, k) in enumerate(zip(x, y, kind, strict=True))]
    rows += [(-1, None, 1.0, 1.0, 2.0, 1.0, "hi"), (-2, 1.0, float("nan"), 1.0, 2.0, 1.0, "hi"), (-3, 1.0, 1.0, 1.0, 2.0, None, None)]
    return spark.createDataFrame(rows, "i int, a double, b double, noise double, twin double, y double, kind string").repartition(6)


def test_split_is_a_property_of_rows(planted):
    train, test = predict.split(planted, 0.25, ["i"])
    again = predict.split(planted.repartition(3), 0.25, ["i"])[1]
    own = {r["i"] for r in test.collect()}
    assert own == {r["i"] for r in again.collect()} and 600 < len(own) < 900
    assert not own & {r["i"] for r in train.collect()} and train.count() + test.count() == planted.count()


def test_least_squares_as_numpy(planted):
    train, test = predict.split(planted, key=["i"])
    made = predict.fit(train, "y", FEATURES)
    x = predict.complete(train, ["y", *FEATURES]).toPandas()
    b, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x[["a", "b", "noise"]]]), x["y"], rcond=None)
    assert made.known["a"] == pytest.approx(b[1], rel=1e-6) and made.known["b"] == pytest.approx(b[2], rel=1e-6)
    assert made.known["noise"] + 2 * made.known["twin"] == pytest.approx(b[3], abs=1e-6)  # the two share it
    whole = predict.complete(test, ["y", *FEATURES])
    z = whole.toPandas()
    off = z["y"] - np.column_stack([np.ones(len(z)), z[["a", "b", "noise"]]]) @ b
    got = predict.measures(made.predict(whole), "y").first()
    assert (got["n"], got["mae"], got["rmse"]) == (len(z), pytest.approx(off.abs().mean(), rel=1e-5), pytest.approx((off**2).mean() ** 0.5, rel=1e-5))
    assert got["r2"] == pytest.approx(1 - (off**2).sum() / ((z["y"] - z["y"].mean()) ** 2).sum(), rel=1e-6)


@pytest.mark.parametrize("model", ["linear", "trees"])
def test_importance_finds_what_was_planted(planted, monkeypatch, model):
    monkeypatch.setattr(predict, "BLOCK_ROWS", 100)
    train, test = predict.split(planted, key=["i"])
    made = predict.fit(train, "y", FEATURES, model=model)
    got = predict.permutation_importance(made, test, key=["i"]).orderBy("rank").collect()
    assert [r["feature"] for r in got][:2] == ["b", "a"] and got[0]["share"] > 0.8
    assert sum(r["share"] for r in got) == pytest.approx(1)
    if model == "linear":  # a shuffle of x costs about twice its variance by its coefficient
        assert got[0]["importance"] == pytest.approx(2 * 9 * 25, rel=0.25)
    else:
        assert made.known["b"] == max(made.known.values())


@pytest.mark.parametrize("model", ["linear", "trees"])
def test_classes(planted, model):
    train, test = predict.split(planted, key=["i"])
    made = predict.fit(train, "kind", ["b", "noise"], kind="classification", model=model)
    scored = made.predict(predict.complete(test, ["kind", "b", "noise"]))
    z = scored.toPandas()
    got = predict.measures(scored, "kind", "classification").first()
    assert got["n"] == len(z) and got["accuracy"] == pytest.approx((z["kind"] == z["prediction"]).mean()) and got["accuracy"] > 0.85
    recalls = [(z["prediction"][z["kind"] == k] == k).mean() for k in ("hi", "lo", "mid")]
    precisions = [(z["kind"][z["prediction"] == k] == k).mean() for k in ("hi", "lo", "mid")]
    assert got["recall"] == pytest.approx(np.mean(recalls)) and got["precision"] == pytest.approx(np.mean(precisions))
    assert predict.permutation_importance(made, test, key=["i"]).first()["feature"] == "b"


def test_nothing_to_fit_or_measure(planted):
    with pytest.raises(ValueError):
        predict.fit(planted.limit(0), "y", ["a"])
    made = predict.fit(planted, "y", ["a"])
    assert predict.permutation_importance(made, planted.limit(0)).count() == 0
    assert predict.measures(made.predict(planted.limit(0)), "y").count() == 0
