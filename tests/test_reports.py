"""Stems, schema reports, samples for normality tests, and the catalog's lists and audit log."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from brinework.functions.stems import stem
from brinework.operators import cleaning, hypothesis_tests, insights
from brinework.sources import catalog

# The examples that Porter gives with his rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "gyroscopic": "gyroscop", "replacement": "replac",
    "adoption": "adopt", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "running": "run", "hoping": "hope",
}


def test_stems_as_published(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    df = spark.createDataFrame([(1, "Hopping, running cats"), (2, None), (3, ""), (4, "é is 42 öfters")], "k int, t string")
    got = {r.k: r.t for r in cleaning.clean_text(df, "t", stem=True).collect()}
    assert got == {1: "hop run cat", 2: None, 3: "", 4: "é is 42 öfters"}


def test_schema_report(spark):
    df = spark.createDataFrame([(i, f"v{i % 9}", None if i % 2 else "x1") for i in range(50)], "n int, s string, p string")
    rules = {"n": {"type": "bigint", "min": 3, "max": 40}, "s": {"allowed": ["v0", "v1"]}, "p": {"pattern": "x"}, "gone": {}}
    got = {(r["column"], r["rule"]): r for r in cleaning.schema_report(df, rules).collect()}
    assert set(got) == {("n", "type"), ("n", "min"), ("n", "max"), ("s", "allowed"), ("p", "pattern")}
    assert got["n", "min"].samples == ["0", "1", "2"] and got["n", "max"].samples == ["41", "42", "43", "44", "45"] and got["n", "type"].samples is None
    assert got["s", "allowed"].samples == ["v2", "v3", "v4", "v5", "v6"] and got["p", "pattern"].samples == ["null"] and got["p", "pattern"].violations == 25
    assert {k for k, r in got.items() if r.severity == "error"} == {("s", "allowed")} and all(r.valid for r in got.values())
    missing = cleaning.schema_report(df, {"gone": {"required": True}}).first()
    assert (missing.valid, missing.severity, missing.samples) == (False, "error", None)
    assert cleaning.schema_report(df, {}).count() == 0
    assert cleaning.schema_report(df.limit(0), {**rules, "lost": {"required": True}}).select("rule", "valid").orderBy("rule").collect() == [("required", False), ("type", False)]


def test_verdicts_of_all_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(np.exp(b)), 1.0, None if i % 2 else float(a), float(i % 3)) for i, (a, b) in enumerate(zip(rng.normal(size=3000), rng.normal(size=3000)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert hypothesis_tests.shapiro_verdicts(df, list("abcde")) == {"a": True, "b": False, "c": None, "d": True, "e": False}
    assert hypothesis_tests.shapiro_verdicts(df, list("abe"), most=200) == {"a": True, "b": False, "e": False}
    assert hypothesis_tests.shapiro_verdicts(df.limit(0), ["a"]) == {"a": None} and hypothesis_tests.shapiro_verdicts(df, []) == {}
    # many rows of few values are no one value
    assert hypothesis_tests.shapiro_wilk(df, "e", most=500).first().n == 500
    assert hypothesis_tests.shapiro_wilk(df, "e", most=500).first().normal is False
    assert "non_normal" in {r.kind for r in insights.insights(df.select("b", "e")).collect()}


def test_catalog_lists(spark):
    day = datetime(2024, 1, 1)
    sets = spark.createDataFrame([("a", day, 5, ["x"]), ("b", day + timedelta(1), None, ["x", "y"]), ("c", None, 9, None), ("d", day, 5, [])], "name string, created_at timestamp, file_size long, tags array<string>")
    assert [r.name for r in catalog.recent(sets, 3).collect()] == ["b", "a", "d"]
    assert [r.name for r in catalog.by_size(sets).collect()] == ["c", "a", "d", "b"]
    assert [r.name for r in catalog.tagged(sets, "x").orderBy("name").collect()] == ["a", "b"] and catalog.tagged(sets, "z").count() == 0
    asked = catalog.ask(spark, "SELECT name FROM {sets} WHERE name = :name", {"name": "a' OR '1' = '1"}, sets=sets)
    assert asked.count() == 0
    assert [r.name for r in catalog.ask(spark, "SELECT name FROM {sets} WHERE file_size > :n ORDER BY name", {"n": 4}, sets=sets).collect()] == ["a", "c", "d"]


def test_statistics_table(spark):
    stats = spark.createDataFrame([("Price", "double", 2.0), ("price_note", "string", None), ("age", "int", 1.0), ("unit_price", "double", 1.0)], "column string, type string, mean double")
    names = lambda df: [r["column"] for r in df.collect()]
    assert names(catalog.statistics_table(stats, "PRICE", order="mean")) == ["price_note", "unit_price", "Price"]
    assert names(catalog.statistics_table(stats, order="mean", descending=True)) == ["Price", "age", "unit_price", "price_note"]
    assert names(catalog.statistics_table(stats, kind="double")) == ["Price", "unit_price"]
    assert names(catalog.statistics_table(stats, "%")) == []


def test_audit_rows(spark, tmp_path):
    log, to = str(tmp_path / "log"), str(tmp_path / "out")
    start = datetime(2024, 1, 1)
    catalog.log_run(spark, log, {"session_id": "s", "dataset": "orders", "started_at": start, "completed_at": start + timedelta(milliseconds=1500), "rows_before": 9, "rows_after": 7, "columns_before": 4, "columns_after": 3, "metrics": {"score": 91.5}, "alerts": ["few"], "error": None})
    catalog.log_run(spark, log, ("t", start + timedelta(1), None, "failed", "{}", 5, None, ["dedupe"]))
    latest, first = catalog.history(spark, log).collect()
    assert (latest.session_id, latest.seconds, latest.rows_removed) == ("t", None, None)
    assert (first.seconds, first.rows_removed, first.columns_removed, first.metrics, first.alerts) == (1.5, 2, 1, {"score": 91.5}, ["few"])
    catalog.export_run(spark, log, "s", to)
    read = spark.read.json(to).collect()
    assert len(read) == 1 and read[0].dataset == "orders" and read[0].metrics.score == 91.5 and read[0].exported_at
    with pytest.raises(ValueError):
        catalog.log_run(spark, log, {"sessions": 1})
