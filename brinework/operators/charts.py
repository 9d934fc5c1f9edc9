"""The data behind charts: each operator gives the rows a renderer draws."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.columns import categorical, long_form, numeric
from brinework.operators.profile import pearson, top_values, value_counts
from brinework.operators.ranges import RANGE_ROWS, dealt
from brinework.operators.ranks import exact_quantiles, quantile_row, quantile_table, running, sizes_of

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5)),
    "stdDev": F.stddev_samp, "variance": F.var_samp,
}


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from the least to the most value; empty bins have no row. Values that do
    not vary are one bin."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    got = df.where(x.isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin"), "_lo", width.alias("_w")).agg(F.count("*").alias("n"))
    return got.select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")


def histogram_stats(df: DataFrame, column: str) -> DataFrame:
    """(mean, median, std)."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).join(quantile_row(df, [column], (0.5,)).select(F.col("_q0")[0].alias("median"))).select("mean", "median", "std")


def density(df: DataFrame, column: str, by: str | None = None, points: int = 100, bins: int = 512) -> DataFrame:
    """(by, x, density): a Gaussian kernel estimate at equal steps from the least to the most value, with Scott's
    bandwidth. Values are counted in fine bins first, so bins and not rows meet the points."""
    v, keys = F.col(column).cast("double"), [by] if by else []
    rows = df.where(v.isNotNull() & (F.col(by).isNotNull() if by else F.lit(True))).select(*keys, v.alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"), (F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("_h")).where("_h > 0")
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    facts = ["_lo", "_hi", "_n", "_h"]
    both = rows.join(ends, keys) if by else rows.join(F.broadcast(ends))
    counts = both.groupBy(*keys, *facts, place.alias("_b")).agg(F.count("*").alias("_c"))
    at = counts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / (points - 1)
    centre = F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
    z = (x - centre) / F.col("_h")
    kernel = F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * 2.5066282746310002)
    return at.groupBy(*keys, "_i", x.alias("x")).agg(F.sum(kernel).alias("density")).drop("_i")


def regression_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """(by, slope, intercept, r, n) of rows that have both; null where x does not vary."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*([by] if by else []), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    got = (both.groupBy(by) if by else both.groupBy()).agg(F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count("*").alias("n"))
    slope = F.try_divide("_c", F.nullif("_vx", F.lit(0.0)))
    r = F.try_divide("_c", F.nullif(F.sqrt(F.col("_vx") * F.col("_vy")), F.lit(0.0)))
    return got.select(*([by] if by else []), slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), r.alias("r"), "n")


def line(df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    """Points by x, then series and y. A full sort: aggregate or down-sample large tables first."""
    keep = [x, *([series] if series else []), y]
    return df.where(F.col(x).isNotNull()).select(*keep).orderBy(*keep)


area = line


def pie(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    return top_values(df, column, k)


def bar(df: DataFrame, x: str, y: str | None = None, k: int = 20) -> DataFrame:
    """(x, value): sums of ``y`` or counts by x, the ``k`` largest; ties by x."""
    value = F.sum(y) if y else F.count("*")
    return df.where(F.col(x).isNotNull()).groupBy(x).agg(F.coalesce(value, F.lit(0)).alias("value")).orderBy(F.desc("value"), x).limit(k)


def box(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, min, q1, median, q3, max, mean, std) of the first five number columns, or those named."""
    columns = columns or numeric(df)[:5]
    q = quantile_table(df, columns, (0.25, 0.5, 0.75), exact).select("column", "q")
    got = long_form(df, columns).where("value is not null").groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return got.join(F.broadcast(q), "column").select("column", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "mean", "std")


def violin(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(by, q1, median, q3, n) by group; ``density`` has the outline."""
    rows = df.where(F.col(by).isNotNull()) if by else df
    got = exact_quantiles(rows, column, (0.25, 0.5, 0.75), [by] if by else [])
    return got.select(*([by] if by else []), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.col("rows").alias("n"))


def time_series(df: DataFrame, at: str, y: str) -> DataFrame:
    """(at, y) in order of time; text is parsed, and what does not parse goes."""
    t = F.try_to_timestamp(at) if dict(df.dtypes)[at] == "string" else F.col(at)
    return df.select(t.alias(at), y).where(F.col(at).isNotNull()).orderBy(at, y)


def aggregated(df: DataFrame, by: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Named aggregates by group: name -> (function, column), functions by ``AGGREGATES``."""
    return df.groupBy(*by).agg(*(AGGREGATES[f](c).alias(name) for name, (f, c) in measures.items()))


def downsample(df: DataFrame, x: str, y: str, points: int = 500, how: str = "avg") -> DataFrame:
    """(bucket, x, y): at most ``points`` equal-width buckets of x, each its mean x and aggregated y."""
    v = F.col(x).cast("double")
    ends = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / points
    place = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(points - 1))).otherwise(0).cast("int")
    return df.where(v.isNotNull()).join(F.broadcast(ends)).groupBy(place.alias("bucket")).agg(F.avg(v).alias("x"), AGGREGATES[how](y).alias("y"))


def ohlc(df: DataFrame, at: str, value: str, unit: str = "month", tie: str | None = None) -> DataFrame:
    """(period, open, high, low, close) of a value by period."""
    key = F.struct(at, *([tie] if tie else []))
    return df.where(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, at).cast("date").alias("period")).agg(F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"))


def column_groups(df: DataFrame) -> DataFrame:
    """(column, type, group) for a column picker."""
    from brinework.functions.columns import boolean, temporal

    groups = {c: g for g, names in (("numeric", numeric(df)), ("categorical", categorical(df)), ("datetime", temporal(df)), ("boolean", boolean(df))) for c in names}
    return df.sparkSession.createDataFrame([(c, k, groups.get(c, "other")) for c, k in df.dtypes], "column string, type string, group string")


def largest_triangles(df: DataFrame, x: str, y: str, points: int = 500, ratio: int = 4) -> DataFrame:
    """(x, y): the ``points`` that keep a line's shape, each with the largest triangle to the one before and the mean of
    the next bucket. Of each of ``ratio * points`` spans of x only the least and largest y, and the ends, are looked at, so
    what one task holds is bounded by the points."""
    v, w = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(v.isNotNull() & w.isNotNull()).select(v.alias("x"), w.alias("y"))
    ends = rows.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    spans = ratio * points
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * spans), F.lit(spans - 1))).otherwise(0)
    here = F.struct("x", "y")
    few = rows.join(F.broadcast(ends)).groupBy(place.alias("_b")).agg(F.min_by(here, F.struct("y", "x")).alias("a"), F.max_by(here, F.struct("y", "x")).alias("b"), F.min(here).alias("c"), F.max(here).alias("d"))
    few = few.select(F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("p")).select("p.*")

    def run(pdf):
        pdf = pdf.sort_values(["x", "y"], ignore_index=True)
        n = len(pdf)
        if n <= points or points < 3:
            return pdf
        px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        edges = np.linspace(1, n - 1, points - 1).astype(int)
        kept, last = [0], 0
        for i in range(points - 2):
            a, b = edges[i], max(edges[i + 1], edges[i] + 1)
            c, d = (edges[i + 1], max(edges[i + 2], edges[i + 1] + 1)) if i + 2 < len(edges) else (n - 1, n)
            mx, my = px[c:d].mean(), py[c:d].mean()
            area = np.abs((px[last] - mx) * (py[a:b] - py[last]) - (px[last] - px[a:b]) * (my - py[last]))
            last = a + int(np.argmax(area))
            kept.append(last)
        return pdf.iloc[sorted({*kept, n - 1})]

    return few.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf[["x", "y"]]), "x double, y double")


def suite(df: DataFrame, most: int = 20) -> DataFrame:
    """(rank, chart, columns) of what to draw: the distributions of seven number columns, a heatmap, those of the first
    five text columns that have at most twenty values, five scatters of pairs with |r| over 0.5, and a box chart."""
    num, cat = numeric(df), categorical(df)
    charts = [("distribution", c) for c in num[:7]]
    charts += [("heatmap", ",".join(num))] if len(num) >= 2 else []
    if cat:
        kinds = {r["column"]: r["n"] for r in value_counts(df, cat[:5]).groupBy("column").agg(F.count("*").alias("n")).collect()}
        charts += [("categorical", c) for c in cat[:5] if kinds.get(c, 0) <= 20]
    if len(num) >= 2:
        pairs = pearson(df, num).where(F.abs("r") > 0.5).orderBy(F.desc(F.abs("r")), "a", "b").limit(5).collect()
        charts += [("scatter", f"{r['a']},{r['b']}") for r in pairs]
    charts += [("box", ",".join(num[:7]))] if num else []
    return df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(charts[:most], 1)], "rank int, chart string, columns string")


def listed(charts: DataFrame, dataset, kind: str | None = None) -> DataFrame:
    """The saved charts of a dataset, in order."""
    out = charts.where(F.col("dataset_id") == dataset)
    return (out.where(F.col("chart_type") == kind) if kind else out).orderBy("order", "id")


def funnel(df: DataFrame, column: str, stages: list[str]) -> DataFrame:
    """(stage, rank, n, share): rows of each stage in order, and their share of the first."""
    counts = df.where(F.col(column).isin(*stages)).groupBy(F.col(column).alias("stage")).agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int")
    first = counts.where(F.col("stage") == stages[0]).agg(F.max("n").alias("_first"))
    return counts.join(F.broadcast(first)).select("stage", rank.alias("rank"), "n", F.try_divide("n", F.col("_first").cast("double")).alias("share"))


def waterfall(df: DataFrame, column: str, value: str) -> DataFrame:
    """(step, change, start, end): sums by step, each from where the one before ended."""
    sums = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("step")).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("change"))
    till = F.sum("change").over(Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("end", till).select("step", "change", (F.col("end") - F.col("change")).alias("start"), "end")


def grid_counts(df: DataFrame, x: str, y: str, cells: int = 20) -> DataFrame:
    """(i, j, n): rows by equal steps of two columns, for density maps."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull()).select(a.alias("_x"), b.alias("_y"))
    ends = rows.agg(F.min("_x").alias("_lx"), F.max("_x").alias("_hx"), F.min("_y").alias("_ly"), F.max("_y").alias("_hy"))
    step = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * cells), F.lit(cells - 1))).otherwise(0).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(step("_x", "_lx", "_hx").alias("i"), step("_y", "_ly", "_hy").alias("j")).agg(F.count("*").alias("n"))


def hexagons(df: DataFrame, x: str, y: str, cells: int = 20, value: str | None = None) -> DataFrame:
    """(x, y, n, mean): rows by hexagons, ``cells`` of them along x, each by its centre, with the mean of ``value`` if there
    is one. A hexagon's centre is on one of two lattices of rectangles; a row belongs to the nearer of its two candidates.
    Rows with a null in x or y are left out; a column that doesn't vary is one row of hexagons."""
    down = max(1, int(cells / 3**0.5))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("_v"))
    ends = rows.agg(*(f(c).alias(f"{k}{c}") for c in ("_x", "_y") for k, f in (("lo", F.min), ("hi", F.max))))

    def place(c: str, n: int):
        width = F.col(f"hi{c}") - F.col(f"lo{c}")
        return F.when(width > 0, (F.col(c) - F.col(f"lo{c}")) / width * n).otherwise(0.0)

    at = rows.join(F.broadcast(ends)).withColumns({"_a": place("_x", cells), "_b": place("_y", down)})
    a, b = F.col("_a"), F.col("_b")
    a1, b1, a2, b2 = F.floor(a + 0.5), F.floor(b + 0.5), F.floor(a) + 0.5, F.floor(b) + 0.5
    first = (a - a1) * (a - a1) + 3 * (b - b1) * (b - b1) < (a - a2) * (a - a2) + 3 * (b - b2) * (b - b2)
    centre = lambda c, p, q, n: F.col(f"lo{c}") + F.when(first, p).otherwise(q) * (F.col(f"hi{c}") - F.col(f"lo{c}")) / n
    got = at.groupBy(centre("_x", a1, a2, cells).alias("x"), centre("_y", b1, b2, down).alias("y")).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return got if value else got.drop("mean")


def normal_quantiles(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """(i, expected, value): exact quantiles of a column at the middles of ``points`` equal shares, each with that of the
    normal distribution of the same mean and deviation. No row for under two values."""
    stats = df.agg(F.count(column), F.avg(column).cast("double"), F.stddev_samp(column)).first()
    shares, n, normal = [(i + 0.5) / points for i in range(points)], stats[0], NormalDist()
    if n < 2:
        return df.sparkSession.createDataFrame([], "i int, expected double, value double")
    places = [p * (n - 1) for p in shares]
    wanted = F.lit(sorted({f(p) for p in places for f in (floor, ceil)}))
    x = df.select(F.col(column).cast("double").alias("_v"))
    here = F.filter(wanted, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    at = {r["k"]: r["_v"] for r in running(sizes_of(x, "_v"), "_v").select("_v", F.explode(here).alias("k")).collect()}  # two for each point
    value = [at[floor(p)] + (at[ceil(p)] - at[floor(p)]) * (p - floor(p)) for p in places]
    rows = [(i, stats[1] + stats[2] * normal.inv_cdf(p), v) for i, (p, v) in enumerate(zip(shares, value, strict=True))]
    return df.sparkSession.createDataFrame(rows, "i int, expected double, value double")


def flows(df: DataFrame, by: str, order: Sequence[str], state: str, levels: int = 5, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(level, source, target, n): how often a journey of ``by`` goes from one ``state`` to the next, at its first step, its
    second and so on; later steps than ``levels`` count in the last level. Rows that tie in ``order`` come by state. Rows
    without ``by`` belong to no journey; a null state is a state.

    Journeys lie in ranges of one order of all rows, so that a very long one fills no task: each range passes its last
    journey's last state and length on to the next."""
    rows = df.where(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.struct(*order).alias("_at"), F.col(state).alias("_s"))
    ranged, part, n = dealt(rows, ["_by", "_at", "_s"], range_rows)
    within = Window.partitionBy(part, "_by").orderBy("_at", "_s")
    steps = ranged.select(part, "_by", "_s", F.row_number().over(within).alias("_i"), F.lag(F.struct("_s")).over(within).alias("_from"))
    place, source = F.col("_i"), F.col("_from")
    if n > 1:
        keys = ranged.groupBy(part, "_by").agg(F.count("*").alias("_n"), F.max_by(F.struct("_s"), F.struct("_at", "_s")).alias("_last"))
        edges = keys.groupBy(part).agg(F.max("_by").alias("_key"), F.max_by("_n", "_by").alias("_n"), F.max_by("_last", "_by").alias("_last"))
        edges = edges.withColumn("_n", F.sum("_n").over(Window.partitionBy("_key").orderBy(part)))
        before = Window.partitionBy(F.lit(0)).orderBy(part)  # a row for each range
        passed = edges.select(F.col(part).alias("_r"), *(F.lag(c).over(before).alias(c) for c in ("_key", "_n", "_last")))
        steps = steps.join(F.broadcast(passed), F.col(part) == F.col("_r"))
        goes_on = F.col("_by") == F.col("_key")
        place = F.col("_i") + F.when(goes_on, F.col("_n")).otherwise(0)
        source = F.when(goes_on & (F.col("_i") == 1), F.col("_last")).otherwise(F.col("_from"))
    moves = steps.select(F.least(place - 1, F.lit(levels)).cast("int").alias("level"), source.alias("_from"), F.col("_s").alias("target")).where("_from is not null")
    return moves.groupBy("level", F.col("_from._s").alias("source"), "target").agg(F.count("*").alias("n"))
