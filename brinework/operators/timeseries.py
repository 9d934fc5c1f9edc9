"""Time series of a date and a number column. A long series is first brought to one value a day, and the numpy work
is on that, whose length is bounded by the days of the range."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.columns import numeric
from brinework.functions.special import normal_cdf
from brinework.operators.profile import date_stats


def daily(df: DataFrame, at: str, value: str) -> DataFrame:
    """(day, value): the mean of each day; text dates that do not parse go."""
    t = F.try_to_timestamp(at) if dict(df.dtypes)[at] == "string" else F.col(at)
    return df.select(t.cast("date").alias("day"), F.col(value).cast("double").alias("value")).where("day is not null and value is not null").groupBy("day").agg(F.avg("value").alias("value"))


def trend(df: DataFrame, at: str, value: str) -> DataFrame:
    """(first, last, trend) of the daily series."""
    one = daily(df, at, value).agg(F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"))
    return one.withColumn("trend", F.when(F.col("last") > F.col("first"), "increasing").when(F.col("last") < F.col("first"), "decreasing").otherwise("stable"))


def moving_average(df: DataFrame, at: str, value: str, period: int) -> DataFrame:
    """(day, value, average): the centred mean over ``period`` days of the range on end, half weights at the ends of an
    even one; null near the ends. Days without a value have none of either. Each day adds to its neighbours, so no task
    walks the whole series."""
    days = daily(df, at, value)
    half = period // 2
    weight = F.when((period % 2 == 0) & (F.abs("_k") == half), 0.5).otherwise(1.0) if period % 2 == 0 else F.lit(1.0)
    near = days.select("day", "value", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_k")).select(F.date_add("day", F.col("_k")).alias("day"), (F.col("value") * weight).alias("_v"))
    sums = near.groupBy("day").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    need = 2 * half + 1
    return days.join(sums, "day").select("day", "value", F.when(F.col("_n") == need, F.col("_s") / period).alias("average"))


def _series(df: DataFrame, at: str, value: str) -> np.ndarray:
    return np.array([r["value"] for r in daily(df, at, value).orderBy("day").collect()])


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    return np.array([1.0 if k == 0 else float(d[k:] @ d[:-k] / (d @ d)) for k in range(lags + 1)])


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """Durbin-Levinson on the autocorrelations."""
    r, out, phi = acf(x, lags), [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        last = (r[k] - phi @ r[k - 1 : 0 : -1][: k - 1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return np.array(out)


def correlations(df: DataFrame, at: str, value: str, most: int = 20) -> DataFrame:
    """(lag, acf, pacf, significant) of the daily series, up to min(``most``, half the days)."""
    x = _series(df, at, value)
    schema = "lag int, acf double, pacf double, significant boolean"
    if len(x) < 10 or x.std() == 0:
        return df.sparkSession.createDataFrame([], schema)
    n = min(most, len(x) // 2)
    a, p = acf(x, n), pacf(x, n)
    return df.sparkSession.createDataFrame([(k, float(a[k]), float(p[k]), bool(k and abs(a[k]) > 2 / np.sqrt(len(x)))) for k in range(n + 1)], schema)


def decompose(df: DataFrame, at: str, value: str, period: int = 7) -> DataFrame:
    """(day, value, trend, seasonal, residual): additive, the seasonal part by weekday-like phase of the day number."""
    moved = moving_average(df, at, value, period)
    phase = F.pmod(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(period))
    out = moved.withColumn("_p", phase)
    season = out.where("average is not null").groupBy("_p").agg(F.avg(F.col("value") - F.col("average")).alias("_s"))
    centre = season.agg(F.avg("_s").alias("_m"))
    season = season.join(F.broadcast(centre)).select("_p", (F.col("_s") - F.col("_m")).alias("seasonal"))
    out = out.join(F.broadcast(season), "_p", "left")
    return out.select("day", "value", F.col("average").alias("trend"), "seasonal", (F.col("value") - F.col("average") - F.col("seasonal")).alias("residual"))


#: The days of a season by how often a series has values.
PERIODS = {"daily": 12, "weekly": 7, "monthly": 30}


def strengths(df: DataFrame, at: str, value: str) -> DataFrame:
    """(frequency, period, trend, seasonal, residual): the deviations of the parts of ``decompose`` by that of the
    series. The period goes by the median gap between days, at most half the days; no row for an irregular series, or
    one of under 24 days."""
    gaps = date_stats(df, at).select("frequency", "distinct_days").first()
    if gaps is None or gaps["frequency"] not in PERIODS or gaps["distinct_days"] < 24:
        return df.sparkSession.createDataFrame([], "frequency string, period int, trend double, seasonal double, residual double")
    period = min(PERIODS[gaps["frequency"]], gaps["distinct_days"] // 2)
    parts = decompose(df, at, value, period)
    share = lambda c: F.try_divide(F.stddev_pop(c), F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias(c)
    return parts.agg(share("trend"), share("seasonal"), share("residual")).select(F.lit(gaps["frequency"]).alias("frequency"), F.lit(int(period)).alias("period"), "trend", "seasonal", "residual")


def analysis(df: DataFrame, at: str, columns: list[str] | None = None) -> DataFrame:
    """(column, statistic, p_value, stationary, acf_1, acf_5, pacf_1, significant_lags, trend) of the first three number
    columns with twenty days or more."""
    rows = []
    for c in (columns or [x for x in numeric(df) if x != at])[:3]:
        test = adf(df, at, c).first()
        if test is None:
            continue
        lags = {r["lag"]: r for r in correlations(df, at, c).collect()}
        of = lambda k, what: float(lags[k][what]) if k in lags else 0.0  # noqa: B023, E731
        rows.append((c, test["statistic"], test["p_value"], test["stationary"], of(1, "acf"), of(5, "acf"), of(1, "pacf"), sum(r["significant"] for r in lags.values()), trend(df, at, c).first()["trend"]))
    return df.sparkSession.createDataFrame(rows, "column string, statistic double, p_value double, stationary boolean, acf_1 double, acf_5 double, pacf_1 double, significant_lags int, trend string")


def forecast(df: DataFrame, at: str, value: str, days: int = 7) -> DataFrame:
    """(day, forecast): the line through the daily series, ``days`` ahead, by least squares."""
    x = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double")
    line = daily(df, at, value).agg(F.regr_slope("value", x).alias("b"), F.regr_intercept("value", x).alias("a"), F.max("day").alias("last"))
    ahead = line.where("last is not null").withColumn("day", F.explode(F.expr(f"sequence(date_add(last, 1), date_add(last, {days}))")))
    return ahead.select("day", (F.col("a") + F.col("b") * x).alias("forecast"))


def adf(df: DataFrame, at: str, value: str) -> DataFrame:
    """(statistic, lags, n, p_value, critical_1, critical_5, critical_10, stationary): augmented Dickey-Fuller with a
    constant, lags by AIC; p-value and critical values by MacKinnon's response surfaces, stationary under 5 percent."""
    x = _series(df, at, value)
    schema = "statistic double, lags int, n long, p_value double, critical_1 double, critical_5 double, critical_10 double, stationary boolean"
    if len(x) < 20 or x.std() == 0:
        return df.sparkSession.createDataFrame([], schema)
    d = np.diff(x)
    most = min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(d) // 2 - 2)

    def ols(lags, skip):
        y = d[skip:]
        cols = [x[skip:-1], np.ones(len(y))] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)]
        m = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        rss = float(((y - m @ beta) ** 2).sum())
        return m, beta, rss, len(y)

    aic = []
    for k in range(most + 1):
        m, _, rss, n = ols(k, most)
        aic.append(n * np.log(rss / n) + 2 * m.shape[1])
    best = int(np.argmin(aic))
    m, beta, rss, n = ols(best, best)
    se = np.sqrt(rss / (n - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0])
    stat = float(beta[0] / se)
    # MacKinnon's surfaces with a constant.
    points = [sum(c / n**i for i, c in enumerate(row)) for row in ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809))]
    if stat > 2.74:
        p = 1.0
    elif stat < -18.83:
        p = 0.0
    else:
        row = (2.1659, 1.4412, 0.038269) if stat <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
        p = normal_cdf(sum(c * stat**i for i, c in enumerate(row)))
    return df.sparkSession.createDataFrame([(stat, best, n, float(p), *map(float, points), p < 0.05)], schema)
