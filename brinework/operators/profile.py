"""Dataset profiling: overview, statistics of columns, correlations, outliers, missingness, constant features. Columns
are profiled together in long form, so a table is read once however wide it is."""

from __future__ import annotations

from itertools import combinations
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.columns import categorical, labelled, long_form, numeric, temporal
from brinework.operators.ranks import order_statistics, quantile_table, running, sizes_of

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and share, columns with any and only missing values, duplicate and
    unique rows, density, columns by kind, their names."""
    n = len(df.columns)
    grouped = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    missing = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)), F.lit(0))
    one = grouped.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_rows"), F.array(*map(missing, df.columns)).alias("_m"))
    lost = F.aggregate("_m", F.lit(0).cast("long"), lambda s, x: s + x)
    one = one.withColumn("missing_cells", lost).withColumn("cells", F.col("rows") * n)
    return one.select(
        "rows", F.lit(n).alias("columns"), "cells", "missing_cells",
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, "cells"), F.lit(0.0)).alias("missing_percent"),
        F.size(F.filter("_m", lambda x: x > 0)).alias("columns_with_missing"),
        F.size(F.filter("_m", lambda x: (x > 0) & (x == F.col("rows")))).alias("columns_all_missing"),
        (F.col("rows") - F.col("unique_rows")).alias("duplicate_rows"), "unique_rows",
        F.coalesce(F.try_divide((F.col("cells") - F.col("missing_cells")) * 100.0, "cells"), F.lit(0.0)).alias("density_percent"),
        F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, "cells"), F.lit(0.0)).alias("sparsity_percent"),
        F.coalesce(F.try_divide((F.col("rows") - F.col("unique_rows")) * 100.0, "rows"), F.lit(0.0)).alias("duplicate_percent"),
        F.lit(len(numeric(df))).alias("numeric_columns"), F.lit(len(categorical(df))).alias("categorical_columns"), F.lit(len(temporal(df))).alias("date_columns"),
        F.lit(",".join(df.columns)).alias("column_names"), F.lit(sum(map(len, df.columns)) / max(1, n)).alias("mean_name_length"),
    )


def _moments(df: DataFrame, columns: list[str], fences: dict | None = None) -> DataFrame:
    """(column, count, missing, mean, std, variance, min, max, zeros, skewness, kurtosis), and the values beyond
    ``fences`` if given, in one pass without a shuffle of cells."""
    one = []
    for c in columns:
        v = F.col(c).cast("double")
        moments = {
            "count": F.count(v), "missing": F.count_if(v.isNull()), "mean": F.avg(v), "std": F.stddev_samp(v), "variance": F.var_samp(v), "min": F.min(v), "max": F.max(v),
            "zeros": F.count_if(v == 0), "skewness": F.skewness(v), "kurtosis": F.kurtosis(v),
        }
        if fences is not None:
            moments["outliers"] = F.count_if((v < fences[c][0]) | (v > fences[c][1])) if fences[c] else F.lit(0).cast("long")
        one.append(F.struct(F.lit(c).alias("column"), *(x.alias(k) for k, x in moments.items())))
    return df.agg(F.array(*one).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def numeric_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A row for each numeric column: counts, moments, percentiles, shape labels, zeros, the three least and largest
    values, fences and outliers. Percentiles are order statistics by brackets, modes and distinct values come from the
    counts of distinct values; all else is one aggregate of the rows."""
    columns = columns or numeric(df)
    spark = df.sparkSession
    if not columns:
        raise ValueError("no numeric columns")
    facts, fences, kinds = [], {}, pa.schema([("column", pa.string()), ("_q", pa.list_(pa.float64())), ("least", pa.list_(pa.float64())), ("largest", pa.list_(pa.float64()))])
    if exact:
        found = order_statistics(df, columns, lambda n: [*(f(p * (n - 1)) for p in QUANTILES for f in (floor, ceil)), *range(3), *range(n - 3, n)])
        for c, (n, at) in zip(columns, found, strict=True):
            q = [at[floor(p * (n - 1))] + (at[ceil(p * (n - 1))] - at[floor(p * (n - 1))]) * (p * (n - 1) - floor(p * (n - 1))) for p in QUANTILES] if n else [None] * len(QUANTILES)
            facts.append((c, q, [at[i] for i in range(min(3, n))], [at[i] for i in range(n - 1, max(n - 4, -1), -1)]))
    else:
        known = {r["column"]: r["q"] for r in quantile_table(df, columns, QUANTILES, False).collect()}
        facts = [(c, known.get(c) or [None] * len(QUANTILES), None, None) for c in columns]
    for c, q, _, _ in facts:
        a, b = q[2], q[4]
        fences[c] = (a - 1.5 * (b - a), b + 1.5 * (b - a)) if a is not None else None
    ranks = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, f, strict=True)) for f in facts], kinds))
    sizes = sizes_of(long_form(df, columns), "value", ["column"])
    common = sizes.groupBy("column").agg(F.count("*").alias("distinct"), F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("mode"))
    one = _moments(df, columns, fences).join(F.broadcast(common), "column", "left").join(F.broadcast(ranks), "column", "left")
    for i, p in enumerate(QUANTILES):
        one = one.withColumn(f"p{round(p * 100)}", F.col("_q")[i])
    one = one.drop("_q").withColumn("distinct", F.coalesce("distinct", F.lit(0))).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("range", F.col("max") - F.col("min"))
    one = one.withColumn("low_fence", F.col("p25") - 1.5 * F.col("iqr")).withColumn("high_fence", F.col("p75") + 1.5 * F.col("iqr"))
    one = one.withColumn("cv_percent", F.coalesce(F.try_divide(F.col("std") * 100, F.nullif("mean", F.lit(0.0))), F.lit(0.0)))
    rows = F.col("count") + F.col("missing")
    one = one.withColumn("missing_percent", F.coalesce(F.try_divide(F.col("missing") * 100.0, rows), F.lit(0.0))).withColumn("zeros_percent", F.coalesce(F.try_divide(F.col("zeros") * 100.0, rows), F.lit(0.0)))
    s, k = F.col("skewness"), F.col("kurtosis")
    one = one.withColumn("skew_label", F.when(F.abs(s) < 0.5, "symmetric").when(s > 0.5, "right").when(s.isNotNull(), "left"))
    return one.withColumn("kurtosis_label", F.when(F.abs(k) < 0.5, "mesokurtic").when(k > 0.5, "leptokurtic").when(k.isNotNull(), "platykurtic"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all non-null values."""
    return long_form(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(value, n) of the ``k`` most common values, ties by value."""
    return value_counts(df, [column]).select("value", "n").orderBy(F.desc("n"), "value").limit(k)


def categorical_stats(df: DataFrame, columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """A row for each string column: counts, most common value, concentration, entropy, Gini index, imbalance, cardinality
    (by the share of distinct values among the non-null ones), and the ten most common values as value=count texts."""
    columns = columns or categorical(df)
    counts = value_counts(df, columns)
    total = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("distinct"), F.max("n").alias("top_count"), F.min("n").alias("least_count"))
    tops = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("a"), "value")).alias("top"))
    p = F.col("n") / F.col("count")
    shares = counts.join(F.broadcast(total), "column")
    mixed = shares.groupBy("column").agg((-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))
    few = _largest(counts, 10)
    gini = _gini(counts, total)
    sizes = df.agg(F.count("*").alias("rows"))
    one = total.join(tops, "column").join(mixed, "column").join(few, "column").join(gini, "column").join(F.broadcast(sizes))
    level = F.col("distinct") / F.col("count")
    return one.select(
        "column", "count", (F.col("rows") - F.col("count")).alias("missing"), "distinct", "top", "top_count",
        (F.col("top_count") * 100.0 / F.col("count")).alias("top_percent"),
        (F.col("top5") * 100.0 / F.col("count")).alias("top5_percent"), (F.col("top10") * 100.0 / F.col("count")).alias("top10_percent"),
        "entropy", F.log2(F.col("distinct").cast("double")).alias("max_entropy"),
        F.when(F.col("distinct") > 1, F.col("entropy") / F.log2(F.col("distinct").cast("double"))).otherwise(0.0).alias("normalized_entropy"),
        "gini", (F.col("top_count") / F.col("least_count")).alias("imbalance_ratio"), (F.col("distinct") > limit).alias("high_cardinality"),
        (F.col("top_count") / F.col("count") > 0.9).alias("imbalanced"),
        F.when(F.col("distinct") <= 1, "constant").otherwise(labelled(level, [(0.01, "low"), (0.1, "medium"), (0.5, "high")], "very_high")).alias("cardinality"), "top_values",
    )


def _largest(counts: DataFrame, k: int) -> DataFrame:
    """(column, top5, top10, top_values): the sums of the largest counts, and the values that have them. Ranks are taken within hash buckets of the values first,
    so no task sorts all values of a column."""
    bucket = F.pmod(F.xxhash64("value"), F.lit(64))
    near = counts.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("column", "_b").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= k)
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= k)
    return ranked.groupBy("column").agg(F.sum(F.when(F.col("_r") <= 5, F.col("n"))).alias("top5"), F.sum("n").alias("top10"), F.transform(F.sort_array(F.collect_list(F.struct("_r", F.concat_ws("=", "value", "n").alias("t")))), lambda x: x["t"]).alias("top_values"))


def _gini(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(column, gini) over ascending shares: values with one count share one rank sum, so a row stands for each
    distinct count and not for each value."""
    sizes = counts.groupBy("column", "n").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("column").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    weighed = sizes.withColumn("before", before).groupBy("column").agg(F.sum(F.col("n") * ranks).alias("_s"))
    both = weighed.join(total.select("column", "count", "distinct"), "column")
    return both.select("column", (2.0 * F.col("_s") / (F.col("distinct") * F.col("count")) - (F.col("distinct") + 1.0) / F.col("distinct")).alias("gini"))


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r, n) of each pair of numeric columns over rows that have both; null where one does not vary."""
    columns = columns or numeric(df)
    exprs = []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
        exprs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"), F.count_if(both).alias("n")).alias(f"_{i}"))
    if not exprs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double, n long")
    one = df.agg(*exprs)
    return one.select(F.explode(F.array(*one.columns)).alias("p")).select("p.*")


def _pair_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, x, y, w): the distinct value pairs of each pair of columns, over rows that have both, and their counts."""
    # equal rows are one row before each becomes a row for every pair
    rows = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns))).groupBy(*(f"_{i}" for i in range(len(columns)))).agg(F.count("*").alias("w"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("x"), F.col(f"_{j}").alias("y")) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
    return rows.select("w", F.explode(F.array(*pairs)).alias("p")).select("p.*", "w").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.sum("w").alias("w"))


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) of each pair over rows that have both: Pearson of average ranks. All pairs share one plan; null where a
    column does not vary."""
    columns = columns or numeric(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    cells, pair = _pair_cells(df, columns), ["a", "b"]

    def ranks(c):
        sizes = cells.groupBy(*pair, c).agg(F.sum("w").alias("n"))
        return running(sizes, c, pair).select(*pair, c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    both = cells.join(ranks("x"), [*pair, "x"]).join(ranks("y"), [*pair, "y"])
    mean = both.groupBy(*pair).agg(F.try_divide(F.sum(F.col("w") * F.col("rx")), F.sum("w").cast("double")).alias("m"))  # the mean of all ranks is the same for both
    w, x, y = F.col("w"), F.col("rx") - F.col("m"), F.col("ry") - F.col("m")
    r = F.try_divide(F.sum(w * x * y), F.nullif(F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)), F.lit(0.0)))
    return both.join(F.broadcast(mean), pair).groupBy(*pair).agg(r.alias("r"))


def _balance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted concordant less discordant pairs of points, by halves of x."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]

    def of(a: int, b: int) -> float:
        if b - a <= 256:
            s = np.sign(x[a:b, None] - x[None, a:b]) * np.sign(y[a:b, None] - y[None, a:b])
            return float(w[a:b] @ s @ w[a:b]) / 2
        mid = int(np.searchsorted(x, x[(a + b) // 2], "left"))
        if mid <= a:
            mid = int(np.searchsorted(x, x[a], "right"))
        if mid >= b:
            return 0.0  # one value of x
        by_y = np.argsort(y[a:mid], kind="stable")
        ys, till = y[a:mid][by_y], np.concatenate([[0.0], np.cumsum(w[a:mid][by_y])])
        under, upto = till[np.searchsorted(ys, y[mid:b], "left")], till[np.searchsorted(ys, y[mid:b], "right")]
        return float(w[mid:b] @ (under - (till[-1] - upto))) + of(a, mid) + of(mid, b)

    return of(0, len(x)) if len(x) else 0.0


#: Ranges of a column for Kendall's tau, and rows whose ranges a task counts at once.
PARTS, COUNTED = 256, 1_000_000


def kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, tau): tau-b of each pair over rows that have both, NaN being none; no row for a pair without such rows.

    Each column is dealt into ranges (even numbers), a value that bounds one being a range of its own (odd ones). Points in
    different ranges of both columns are settled by the counts of the grid of ranges; those in one range of either column
    are counted within it, a task for each range and all its pairs of columns; those in one range of both would be counted
    twice and are taken off once. A range of one value has ties only and is counted by the grid."""
    columns = columns or numeric(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, tau double")
    names, pairs = [f"_{i}" for i in range(len(columns))], list(combinations(range(len(columns)), 2))
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for n, c in zip(names, columns, strict=True)))
    points = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    found = values.agg(*(F.percentile_approx(n, points, 10_000).alias(n) for n in names)).first()
    bounds = [np.unique(np.array(found[n] or [], dtype=np.float64)) for n in names]
    # equal rows are one row before they meet any pair
    rows = values.groupBy(*names).agg(F.count("*").cast("double").alias("w"))

    def ranges(j: int, v: np.ndarray) -> np.ndarray:
        """Twice the bounds below each value, one more for a bound, -1 for none."""
        at = np.searchsorted(bounds[j], v)
        same = np.append(bounds[j], np.nan)[np.minimum(at, len(bounds[j]))] == v
        return np.where(np.isnan(v), -1, 2 * at + same)

    def cells(batches):
        """(p, i, j, w) of some rows at a time: the weight of each cell of a pair's grid."""

        def counted(held):
            code, w = [np.concatenate(c) for c in zip(*(c for c, _ in held))], np.concatenate([w for _, w in held])
            for p, (a, b) in enumerate(pairs):
                wide, both = 2 * len(bounds[b]) + 1, (code[a] >= 0) & (code[b] >= 0)
                sums = np.bincount(code[a][both] * wide + code[b][both], weights=w[both])
                full = np.flatnonzero(sums)
                yield pd.DataFrame({"p": p, "i": full // wide, "j": full % wide, "w": sums[full]})

        held, size = [], 0
        for pdf in batches:
            held.append(([ranges(j, pdf[n].to_numpy(np.float64)) for j, n in enumerate(names)], pdf["w"].to_numpy(np.float64)))
            size += len(pdf)
            if size >= COUNTED:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    tied = lambda t: float((t * (t - 1) / 2).sum())
    form = "p int, s double, n double, tx double, ty double"

    def of_grid(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, w = (pdf[c].to_numpy(float) for c in ("i", "j", "w"))
        one_value = lambda at: np.bincount(at.astype(int), weights=w)[1::2]
        return pd.DataFrame({"p": [key[0]], "s": [_balance(i, j, w)], "n": [w.sum()], "tx": [tied(one_value(i))], "ty": [tied(one_value(j))]})

    def dealt(batches):
        for pdf in batches:
            for j, n in enumerate(names):
                at = ranges(j, pdf[n].to_numpy(np.float64))
                some = (at >= 0) & (at % 2 == 0)
                if some.any():
                    yield pdf[some].assign(c=j, r=at[some])

    def of_range(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out, c = [], int(key[0])
        for p, pair in enumerate(pairs):
            if c not in pair:
                continue
            d = pair[0] + pair[1] - c
            some = pdf[pdf[names[d]].notna()]
            x, y, w = (some[k].to_numpy(float) for k in (names[c], names[d], "w"))
            s = _balance(x, y, w)
            if c == pair[0]:  # those in one cell of the grid are counted by the other column
                at = ranges(d, y)
                order = np.argsort(at, kind="stable")
                for cell in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(cell) > 1 and at[cell[0]] % 2 == 0:
                        s -= _balance(x[cell], y[cell], w[cell])
            t = tied(np.bincount(np.unique(x, return_inverse=True)[1], weights=w))
            out.append((p, s, 0.0, t if c == pair[0] else 0.0, t if c == pair[1] else 0.0))
        return pd.DataFrame(out, columns=["p", "s", "n", "tx", "ty"])

    grid = rows.mapInPandas(cells, "p int, i long, j long, w double").groupBy("p", "i", "j").agg(F.sum("w").alias("w")).groupBy("p").applyInPandas(of_grid, form)
    within = rows.mapInPandas(dealt, ", ".join(f"{n} double" for n in names) + ", w double, c int, r int").groupBy("c", "r").applyInPandas(of_range, form)
    one = grid.union(within).groupBy("p").agg(*(F.sum(c).alias(c) for c in ("s", "n", "tx", "ty"))).where("n > 0").withColumn("n", F.col("n") * (F.col("n") - 1) / 2)
    known = F.array(*(F.struct(F.lit(columns[a]).alias("a"), F.lit(columns[b]).alias("b")) for a, b in pairs))
    tau = F.try_divide("s", F.nullif(F.sqrt(F.col("n") - F.col("tx")) * F.sqrt(F.col("n") - F.col("ty")), F.lit(0.0)))
    return one.select(known[F.col("p")].alias("k"), tau.alias("tau")).select("k.*", "tau")


def correlations(df: DataFrame, method: str = "all", columns: list[str] | None = None) -> DataFrame:
    """(a, b, pearson, spearman, kendall) of each pair, or (a, b, r) by one method."""
    one = {"pearson": lambda: pearson(df, columns).select("a", "b", "r"), "spearman": lambda: spearman(df, columns), "kendall": lambda: kendall(df, columns).withColumnRenamed("tau", "r")}
    if method != "all":
        if method not in one:
            raise ValueError(f"method must be all or one of {', '.join(one)}")
        return one[method]()
    frames = [f().withColumnRenamed("r", k) for k, f in one.items()]
    return frames[0].join(frames[1], ["a", "b"], "left").join(frames[2], ["a", "b"], "left")


def strong_pairs(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs with |r| over ``least``, their strength, direction and whether they are near perfect (|r| over 0.99);
    strongest first. Where ``pairs`` has pearson, spearman and kendall, r is Pearson's and ``agreement`` tells whether
    their signs are one, two or three different ones."""
    every = {"pearson", "spearman", "kendall"} <= set(pairs.columns)
    if every:
        signs = F.size(F.array_distinct(F.array(*(F.signum(F.coalesce(c, F.lit(float("nan")))) for c in ("pearson", "spearman", "kendall")))))
        pairs = pairs.withColumn("r", F.col("pearson")).withColumn("agreement", F.when(signs == 1, "all_agree").when(signs == 2, "partial_agreement").otherwise("conflicting"))
    r = F.abs("r")
    strength = F.when(r > 0.9, "very_strong").when(r > 0.7, "strong").when(r > 0.5, "moderate").when(r > 0.3, "weak").otherwise("very_weak")
    out = pairs.where(r > least).withColumn("strength", strength).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative")).withColumn("perfect", r > 0.99)
    return out.orderBy(F.desc(r), "a", "b")


def pairs_above(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(n): pairs with |r| of ``least`` or more, each once."""
    return pairs.agg(F.count_if(F.abs("r") >= least).alias("n"))


def distribution_type(stats: DataFrame) -> DataFrame:
    """(column, distribution) from skewness and kurtosis; the first rule that holds."""
    s, k = F.col("skewness"), F.col("kurtosis")
    label = (
        F.when((F.abs(s) < 0.5) & (F.abs(k) < 0.5), "normal").when(s > 1, "right_skewed").when(s < -1, "left_skewed")
        .when(k > 3, "heavy_tailed").when(k < -1, "light_tailed").when(F.abs(s) < 0.5, "symmetric_non_normal").otherwise("unknown")
    )
    return stats.select("column", label.alias("distribution"))


def distribution_counts(types: DataFrame) -> DataFrame:
    """(normal_columns, right_skewed, left_skewed, heavy_tailed) of ``distribution_type``."""
    n = lambda x: F.count_if(F.col("distribution") == x)
    return types.agg(n("normal").alias("normal_columns"), n("right_skewed").alias("right_skewed"), n("left_skewed").alias("left_skewed"), n("heavy_tailed").alias("heavy_tailed"))


SEVERITIES = [(1, "low"), (5, "moderate"), (10, "high")]


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, n, low, high, mild, extreme, total, percent, severity, severity_of_fraction) of columns with ten values or
    more: beyond 1.5 and 3 interquartile ranges of the quartiles. ``severity_of_fraction`` labels the fraction by the
    steps of a percentage, as some reports do, and so is always low."""
    columns = columns or numeric(df)
    found = [(r["column"], r["rows"], *r["q"]) for r in quantile_table(df, columns, (0.25, 0.75), exact).collect() if r["rows"] >= 10]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, n long, low double, high double, mild long, extreme long, total long, percent double, severity string, severity_of_fraction string")
    rows = []
    for c, n, a, b in found:
        v, w = F.col(c).cast("double"), b - a
        total, extreme = F.count_if((v < a - 1.5 * w) | (v > b + 1.5 * w)), F.count_if((v < a - 3 * w) | (v > b + 3 * w))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(n).cast("long").alias("n"), F.lit(a - 1.5 * w).alias("low"), F.lit(b + 1.5 * w).alias("high"), (total - extreme).alias("mild"), extreme.alias("extreme"), total.alias("total")))
    got = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    got = got.withColumn("percent", F.col("total") * 100.0 / F.col("n"))
    return got.withColumn("severity", labelled(F.col("percent"), SEVERITIES, "very_high")).withColumn("severity_of_fraction", labelled(F.col("percent") / 100, SEVERITIES, "very_high"))


def outlier_summary(outliers: DataFrame) -> DataFrame:
    """(total, columns_with_outliers, columns_analyzed) of an outlier table."""
    return outliers.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_if(F.col("total") > 0).alias("columns_with_outliers"), F.count("*").alias("columns_analyzed"))


def outlier_rows(df: DataFrame, key: list[str], columns: list[str] | None = None, most: int = 50, exact: bool = True) -> DataFrame:
    """(column, key..., value): the first ``most`` outliers of each column in the order of ``key``."""
    columns = columns or numeric(df)
    fences = iqr_outliers(df, columns, exact).select("column", "low", "high")
    odd = long_form(df, columns, keep=key).join(F.broadcast(fences), "column").where("value < low or value > high")
    return odd.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(*key))).where(F.col("_r") <= most).select("column", *key, "value")


def zscore_outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """(column, n, total, in_2_3, in_3_4, over_4, min_z, max_z, advice) of columns with ten values or more that vary."""
    columns = columns or numeric(df)
    m = _moments(df, columns).where("count >= 10 and std > 0").select("column", "mean", "std", F.col("count").alias("n"))
    scored = long_form(df, columns).where("value is not null").join(F.broadcast(m), "column").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    a = F.abs("z")
    got = scored.groupBy("column", "n").agg(F.count_if(a > threshold).alias("total"), F.count_if((a > 2) & (a <= 3)).alias("in_2_3"), F.count_if((a > 3) & (a <= 4)).alias("in_3_4"), F.count_if(a > 4).alias("over_4"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.max(a).alias("_most"))
    # The advice by the largest score.
    advice = F.when(F.col("_most") > 5, "Extreme outliers detected - investigate data quality issues").when(F.col("_most") > 4, "Significant outliers - consider removal or transformation").when(F.col("_most") > 3, "Moderate outliers - analyze context before action").otherwise("Outliers within normal range")
    return got.withColumn("advice", advice).drop("_most")


def missing_patterns(df: DataFrame) -> DataFrame:
    """(column, missing, percent, band, kind, advice) of each column. kind and advice are null where nothing is missing."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), F.lit(c in numeric(df)).alias("is_number")) for c in df.columns))
    out = one.select("_rows", F.explode(rows).alias("r")).select("_rows", "r.*")
    share = F.coalesce(F.try_divide(F.col("missing") * 100.0, "_rows"), F.lit(0.0))
    out = out.withColumn("percent", share)
    p = F.col("percent")
    # Kinds by the share that is missing, and what to do about them.
    kind = F.when(p > 0, labelled(p, [(5, "MCAR_likely"), (30, "MAR_possible")], "MNAR_possible"))
    band = F.when(p == 0, "none").when(p > 50, "high").when(p > 10, "moderate").otherwise("low")
    advice = F.when(p > 0, F.when(~F.col("is_number"), "mode_or_ml_based").when(kind == "MCAR_likely", "mean_or_median").otherwise("ml_based_imputation"))
    return out.select("column", "missing", "percent", band.alias("band"), kind.alias("kind"), advice.alias("advice"))


def missing_correlation(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of columns whose missing cells go together, |r| over ``least``."""
    flags = df.select(*(F.col(c).isNull().cast("double").alias(c) for c in df.columns))
    return pearson(flags, df.columns).where(F.abs("r") > least).withColumn("strength", F.when(F.abs("r") > 0.7, "strong").otherwise("moderate"))


def constant_features(df: DataFrame, quasi: float = 0.95, low: float = 0.90) -> DataFrame:
    """(column, distinct, top_share, kind): constant, quasi-constant or low-variance columns by the share of the most
    common value among the non-null ones."""
    c = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("top_share"))
    kind = F.when(F.col("distinct") == 1, "constant").when(F.col("top_share") > quasi, "quasi-constant").when(F.col("top_share") > low, "low-variance")
    return c.withColumn("kind", kind).where("kind is not null")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, null_percent, distinct, min, max, mean, median, std, top_values) of each column; the five most
    common values as value=count texts where there are under 50 distinct ones."""
    num, kinds = numeric(df), dict(df.dtypes)
    one = []
    for c in df.columns:
        v = F.col(c).cast("double") if c in num else F.lit(None).cast("double")
        one.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")))
    got = df.agg(F.count("*").alias("rows"), F.array(*one).alias("c")).select("rows", F.explode("c").alias("c")).select("rows", "c.*")
    got = got.withColumn("null_percent", F.coalesce(F.try_divide(F.col("nulls") * 100.0, "rows"), F.lit(0.0))).drop("rows")
    counts = value_counts(df, df.columns)
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    near = counts.join(F.broadcast(distinct.where("distinct < 50").select("column")), "column")
    tops = near.groupBy("column").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), "value"))), 1, 5), lambda x: F.concat_ws("=", x["value"], -x["a"])), ",").alias("top_values"))
    middle = quantile_table(df, num, (0.5,)).select("column", F.col("q")[0].alias("median")) if num else df.sparkSession.createDataFrame([], "column string, median double")
    out = got.join(F.broadcast(distinct), "column", "left").join(F.broadcast(tops), "column", "left").join(F.broadcast(middle), "column", "left")
    return out.withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def compare(frames: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(dataset, column, mean, median, std, min, max, nulls) of the same columns of several datasets."""
    out = None
    for name, df in frames.items():
        s = numeric_stats(df, columns).select(F.lit(name).alias("dataset"), "column", "mean", F.col("p50").alias("median"), "std", "min", "max", F.col("missing").alias("nulls"))
        out = s if out is None else out.unionByName(s)
    return out


def date_stats(df: DataFrame, column: str) -> DataFrame:
    """(first, last, days, distinct_days, missing_days, median_gap_days, frequency) of a date column. Gaps are between
    the distinct days, of which there are at most as many as days in the range. No row for under ten dates."""
    t = F.try_to_timestamp(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    days = df.select(t.cast("date").alias("day")).where("day is not null").groupBy("day").count()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(F.lit(0)).orderBy("day")))
    one = days.withColumn("gap", gap).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("distinct_days"), F.percentile("gap", F.lit(0.5)).alias("median_gap_days"), F.sum("count").alias("_dates")).where("_dates >= 10")
    span = F.datediff("last", "first")
    freq = F.when(F.col("median_gap_days") <= 1, "daily").when(F.col("median_gap_days") <= 7, "weekly").when(F.col("median_gap_days") <= 31, "monthly").otherwise("irregular")
    return one.select("first", "last", span.alias("days"), "distinct_days", (span + 1 - F.col("distinct_days")).alias("missing_days"), "median_gap_days", freq.alias("frequency"))
