"""Data-quality scores. The five definitions differ on purpose and keep separate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.functions.columns import categorical, labelled, numeric
from brinework.operators.profile import iqr_outliers, overview, value_counts


def _clamp(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def _weighted(weights: dict[str, float]) -> Column:
    return sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))


def _one(df: DataFrame, **values: Column) -> DataFrame:
    """A row of constants, for tables without columns of a kind."""
    return df.sparkSession.range(1).select(*(v.alias(k) for k, v in values.items()))


def catalog_score(df: DataFrame) -> DataFrame:
    """100 (1 - 0.7 missing ratio - 0.3 duplicate ratio), within 0 and 100; 0 for no rows."""
    o = overview(df)
    lost, dup = F.try_divide("missing_cells", F.col("cells").cast("double")), F.try_divide("duplicate_rows", F.col("rows").cast("double"))
    return o.select(F.when(F.col("rows") > 0, _clamp(100 * (1 - 0.7 * lost - 0.3 * dup))).otherwise(0.0).alias("score"), "rows", "missing_cells", "duplicate_rows")


# The weights, classes and actions of the profile's score.
EDA_WEIGHTS = {"completeness": 0.25, "uniqueness": 0.20, "validity": 0.25, "consistency": 0.15, "accuracy": 0.10, "timeliness": 0.05}
EDA_CLASSES = [(40, "Very Poor"), (60, "Poor"), (75, "Fair"), (90, "Good")]
EDA_ACTIONS = {
    "completeness": "Handle missing values", "uniqueness": "Remove duplicate records", "validity": "Address outliers and invalid values",
    "consistency": "Standardize data formats", "accuracy": "Validate data ranges and types", "timeliness": "Update stale records",
}


def eda_score(df: DataFrame, exact: bool = True) -> DataFrame:
    """Six dimensions, their weighted score, its class, and those of the three lowest dimensions that are under 85.

    Kept as given: consistency is 50 wherever a string column has values and 100 otherwise; accuracy loses the share of
    number columns that are called something with "age", or with "price" and have a negative minimum; timeliness is 100."""
    num, cat = numeric(df), categorical(df)
    o = overview(df).select("missing_percent", "duplicate_percent")
    odd = iqr_outliers(df, num, exact).agg(F.coalesce(F.avg("percent"), F.lit(0.0)).alias("odd")) if num else _one(df, odd=F.lit(0.0))
    seen = df.agg(F.count(F.coalesce(*(F.col(c) for c in cat)) if len(cat) > 1 else F.col(cat[0])).alias("c")) if cat else _one(df, c=F.lit(0))
    aged = [c for c in num if "age" in c.lower()]
    priced = [c for c in num if "price" in c.lower() and c not in aged]
    faults = df.agg(sum((F.coalesce((F.min(c) < 0).cast("int"), F.lit(0)) for c in priced), F.lit(len(aged))).alias("faults")) if num else _one(df, faults=F.lit(0))
    one = o.join(odd).join(seen).join(faults)
    dims = {
        "completeness": 100 - F.col("missing_percent"), "uniqueness": 100 - F.col("duplicate_percent"), "validity": 100 - F.least(F.col("odd"), F.lit(100.0)),
        "consistency": F.when(F.col("c") > 0, 50.0).otherwise(100.0), "accuracy": 100 - F.col("faults") * 100.0 / max(1, len(num)), "timeliness": F.lit(100.0),
    }
    one = one.select(*(v.alias(k) for k, v in dims.items()))
    score = _weighted(EDA_WEIGHTS)
    lowest = F.slice(F.array_sort(F.array(*(F.struct(F.col(k).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(dims)))), 1, 3)
    poor = F.array_join(F.transform(F.filter(lowest, lambda d: d["v"] < 85), lambda d: d["k"]), ",")
    return one.select(*dims, score.alias("score"), labelled(score, EDA_CLASSES, "Excellent").alias("grade"), poor.alias("priorities"))


def eda_priorities(score: DataFrame) -> DataFrame:
    """(rank, dimension, action, value) of the priorities of ``eda_score``; no row where nothing is under 85."""
    named = score.select(F.posexplode(F.split("priorities", ",")).alias("rank", "dimension"), *EDA_ACTIONS).where("dimension <> ''")
    action = F.create_map(*(F.lit(x) for kv in EDA_ACTIONS.items() for x in kv))[F.col("dimension")]
    value = F.create_map(*(x for k in EDA_ACTIONS for x in (F.lit(k), F.col(k))))[F.col("dimension")]
    return named.select((F.col("rank") + 1).alias("rank"), "dimension", action.alias("action"), value.alias("value"))


# The weights, letters and alert thresholds of the cleaning score.
CLEANING_WEIGHTS = {"completeness": 0.30, "uniqueness": 0.20, "consistency": 0.20, "validity": 0.10, "accuracy": 0.10, "timeliness": 0.10}
LETTERS = [(60, "F"), (70, "D"), (75, "C"), (80, "C+"), (85, "B"), (90, "B+"), (95, "A")]
ALERTS = {"score": 85, "completeness": 95, "uniqueness": 80, "consistency": 90, "validity": 95, "accuracy": 90, "timeliness": 90}
STATUSES = [(60, "poor"), (70, "needs_improvement"), (80, "acceptable"), (90, "good")]


def cleaning_score(df: DataFrame) -> DataFrame:
    """Six dimensions of the cleaning report, their weighted score and letter grade. Uniqueness is the mean share of
    distinct values among all rows, validity the share of number cells that are not infinite, nulls among them; accuracy
    and timeliness are fixed at 100. A column has one type here, so none is of mixed types."""
    num, n = numeric(df), len(df.columns)
    o = overview(df).select("missing_percent", "rows", "duplicate_rows")
    distinct = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("distinct_values"))
    infinite = df.agg(sum((F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in num), F.lit(0)).alias("infinite")) if num else _one(df, infinite=F.lit(0))
    rows = F.col("rows").cast("double")
    one = o.join(distinct).join(infinite).select(
        (100 - F.col("missing_percent")).alias("completeness"), F.coalesce(F.try_divide(F.col("distinct_values") * 100.0, rows * n), F.lit(100.0)).alias("uniqueness"),
        F.coalesce(100 - F.try_divide(F.col("duplicate_rows") * 100.0, rows), F.lit(100.0)).alias("consistency"),
        F.coalesce(100 - F.try_divide(F.col("infinite") * 100.0, rows * len(num)), F.lit(100.0)).alias("validity"), F.lit(100.0).alias("accuracy"), F.lit(100.0).alias("timeliness"),
        "duplicate_rows", F.col("infinite").alias("infinite_values"),
    )
    return one.withColumn("score", _weighted(CLEANING_WEIGHTS)).withColumn("letter", labelled(F.col("score"), LETTERS, "A+"))


def alerts(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(dimension, value, threshold, severity) of the dimensions under their thresholds; severity by the gap."""
    cells = F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value"), F.lit(float(t)).alias("threshold")) for k, t in (thresholds or ALERTS).items() if k in scores.columns))
    gap = F.col("threshold") - F.col("value")
    out = scores.select(F.explode(cells).alias("c")).select("c.*").where("value < threshold")
    return out.withColumn("severity", F.when(gap >= 20, "critical").when(gap >= 10, "high").when(gap >= 5, "medium").otherwise("low"))


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, value, status, advice) of a cleaned table: its score with an overall status, each dimension as pass,
    warning (within ten of its threshold) or fail, and the percent of rows lost, with advice where one is due."""
    s = cleaning_score(after).join(before.agg(F.count("*").alias("rows_before"))).join(after.agg(F.count("*").alias("rows_after")))
    v = F.col
    loss = F.coalesce(F.try_divide((v("rows_before") - v("rows_after")) * 100.0, v("rows_before")), F.lit(0.0))
    missing = 100 - v("completeness")
    advice = {
        "score": F.when(v("score") < 70, "critical: re-run cleaning with more aggressive parameters"),
        "completeness": F.when(v("completeness") < 95, F.concat(F.when(missing > 10, "high").otherwise("medium"), F.format_string(": address %.1f%% missing data", missing))),
        "uniqueness": F.when(v("uniqueness") < 80, "medium: review columns with low uniqueness"),
        "consistency": F.when((v("consistency") < 90) & (v("duplicate_rows") > 0), F.format_string("high: remove or investigate %d duplicate rows", v("duplicate_rows"))),
        "validity": F.when((v("validity") < 95) & (v("infinite_values") > 0), "high: fix infinite values"),
    }
    rows = [F.struct(F.lit("score").alias("dimension"), v("score").alias("value"), labelled(v("score"), STATUSES, "excellent").alias("status"), advice["score"].alias("advice"))]
    for k, t in ALERTS.items():
        if k != "score":
            status = F.when(v(k) >= t, "pass").when(v(k) >= t - 10, "warning").otherwise("fail")
            rows.append(F.struct(F.lit(k).alias("dimension"), v(k).alias("value"), status.alias("status"), advice.get(k, F.lit(None).cast("string")).alias("advice")))
    rows.append(F.struct(F.lit("rows_lost_percent").alias("dimension"), loss.alias("value"), F.lit("info").alias("status"), F.lit(None).cast("string").alias("advice")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def live_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rows_before, rows_after, completeness, uniqueness, fixed_score, fixed_grade, score, letter) of a cleaning run. The
    run reports a fixed score beside the two dimensions it measures; ``score`` and ``letter`` are those of
    ``cleaning_score``."""
    s = cleaning_score(after).select("completeness", F.col("consistency").alias("uniqueness"), "score", "letter")
    counts = before.agg(F.count("*").alias("rows_before")).join(after.agg(F.count("*").alias("rows_after")))
    return counts.join(s).select("rows_before", "rows_after", "completeness", "uniqueness", F.lit(85.0).alias("fixed_score"), F.lit("B").alias("fixed_grade"), "score", "letter")


def chart_score(df: DataFrame, exact: bool = True) -> DataFrame:
    """Completeness, uniqueness, validity (columns that are neither over 1 % infinite nor nearly all-distinct text) and
    consistency (100 less twice the mean percent of outliers among all rows), and their weighted score."""
    num, cat, n = numeric(df), categorical(df), len(df.columns)
    o = overview(df).select("rows", "missing_percent", "duplicate_percent")
    rows = F.col("rows").cast("double")
    infinite = df.agg(F.array(*(F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in num)).alias("inf")) if num else _one(df, inf=F.array().cast("array<bigint>"))
    distinct = value_counts(df, cat).groupBy("column").agg(F.count("*").alias("d")).agg(F.collect_list("d").alias("kinds")) if cat else _one(df, kinds=F.array().cast("array<bigint>"))
    odd = iqr_outliers(df, num, exact).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("odd")) if num else _one(df, odd=F.lit(0))
    bad = F.size(F.filter("inf", lambda x: x > F.col("rows") * 0.01)) + F.size(F.filter("kinds", lambda x: x > F.col("rows") * 0.95))
    percent = F.coalesce(F.try_divide(F.col("odd") * 100.0, rows * max(1, len(num))), F.lit(0.0))
    one = o.join(infinite).join(distinct).join(odd).select(
        F.when(rows > 0, 100 - F.col("missing_percent")).otherwise(0.0).alias("completeness"), F.when(rows > 0, 100 - F.col("duplicate_percent")).otherwise(0.0).alias("uniqueness"),
        (100 - bad * 100.0 / max(1, n)).alias("validity"), F.greatest(F.lit(0.0), 100 - 2 * percent).alias("consistency"),
    )
    return one.withColumn("score", 0.40 * F.col("completeness") + 0.25 * F.col("uniqueness") + 0.25 * F.col("validity") + 0.10 * F.col("consistency"))


def dashboard_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """(rows, columns, numeric_columns, categorical_columns, date_columns, quality_score, null_percent, duplicate_percent).
    Memory has no meaning for a distributed table; ``size_text`` of the scalar functions writes file sizes."""
    o = overview(df).select("rows", "columns", "numeric_columns", "categorical_columns", "date_columns", F.col("missing_percent").alias("null_percent"), "duplicate_percent")
    return o.join(chart_score(df, exact).select(F.col("score").alias("quality_score")))


def suggestions(df: DataFrame) -> DataFrame:
    """(rank, kind, name, severity, strategy, preset): the issues of a table and what to do about them."""
    o = overview(df).join(catalog_score(df).select("score"))
    dup, lost = F.col("duplicate_percent"), F.col("missing_percent")
    none = F.lit(None).cast("string")

    def row(rank, kind, name, severity=none, strategy=none, preset=none):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), text(severity).alias("severity"), text(strategy).alias("strategy"), text(preset).alias("preset"))

    # Strategies and presets by the percent that is missing, and by the score.
    by_missing = lambda a, b, c: F.when(lost > 15, a).when(lost > 5, b).otherwise(c)
    low = F.col("score") < 70
    rows = F.array(
        F.when(F.col("duplicate_rows") > 0, row(1, "issue", "duplicates", F.when(dup > 5, "high").otherwise("medium"))),
        F.when(F.col("duplicate_rows") > 0, row(2, "recommendation", "remove_duplicates", preset="standard")),
        F.when(F.col("missing_cells") > 0, row(3, "issue", "missing_values", F.when(lost > 10, "high").otherwise("medium"))),
        F.when(F.col("missing_cells") > 0, row(4, "recommendation", "handle_missing", strategy=by_missing("knn", "median", "drop"), preset=by_missing("aggressive", "standard", "minimal"))),
        F.when(low, row(5, "recommendation", "comprehensive_cleaning", preset="production")),
        F.when(~low, row(5, "recommendation", "ml_preparation", preset="ml_ready")),
    )
    return o.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def health(df: DataFrame) -> DataFrame:
    """(rows, missing_ratio, duplicate_ratio, healthy)."""
    o = overview(df)
    lost = F.coalesce(F.try_divide("missing_cells", F.col("cells").cast("double")), F.lit(0.0))
    dup = F.coalesce(F.try_divide("duplicate_rows", F.col("rows").cast("double")), F.lit(0.0))
    return o.select("rows", lost.alias("missing_ratio"), dup.alias("duplicate_ratio"), ((lost <= 0.5) & (dup <= 0.3)).alias("healthy"))


def input_problems(df: DataFrame, many: int = 10_000_000) -> DataFrame:
    """(problem, detail): no rows, blank column names, all-null columns, very many rows."""
    one = df.agg(F.count("*").alias("rows"), *(F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(df.columns)))
    rows = [F.when(F.col("rows") == 0, F.struct(F.lit("empty").alias("problem"), F.lit("").alias("detail"))), F.when(F.col("rows") > many, F.struct(F.lit("many rows").alias("problem"), F.col("rows").cast("string").alias("detail")))]
    rows += [F.struct(F.lit("blank name").alias("problem"), F.lit(str(i)).alias("detail")) for i, c in enumerate(df.columns) if not c.strip()]
    rows += [F.when((F.col("rows") > 0) & (F.col(f"_{i}") == 0), F.struct(F.lit("all null").alias("problem"), F.lit(c).alias("detail"))) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")


def validate(df: DataFrame, strict: bool = True) -> DataFrame:
    """``df`` as it is; raises with all problems of the input where ``strict``, but for many rows."""
    found = [f"{r['problem']} {r['detail']}".strip() for r in input_problems(df).collect() if r["problem"] != "many rows"]
    if strict and found:
        raise ValueError("; ".join(found))
    return df
