"""Order statistics of whole columns without a task that sorts them: distinct values with their counts, dealt into ranges
by a sketch of the values, are ranked range by range, and each range starts where the counts of those before it end."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the distinct values of a column are dealt into. A window over their sums has a row for each.
RANGES = 64


def sizes_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n) of the non-null values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def running(sizes: DataFrame, value: str, by: Sequence[str] = (), n: str = "n", name: str = "before") -> DataFrame:
    """``sizes`` (by..., a number ``value``, a count ``n``) with the sum of the counts of all lesser values of the same
    ``by``. Groups without a key, or with few keys and many values, are dealt over ``RANGES`` tasks each."""
    by = list(by)
    # bounds of the distinct values: a value that is very common is still one row here
    points = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    if not by:
        found = sorted(set(sizes.agg(F.percentile_approx(F.col(value).cast("double"), points, 2000)).first()[0] or []))
        return _summed(sizes.withColumn("_range", _range_of(F.col(value).cast("double"), found)), value, by, n, name)
    bounds = sizes.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), points, 2000).alias("_bounds"))
    known = {f"_by{i}": c for i, c in enumerate(by)}
    bounds = bounds.select(*(F.col(c).alias(k) for k, c in known.items()), "_bounds")
    same = [F.col(c).eqNullSafe(F.col(k)) for k, c in known.items()]
    placed = sizes.join(bounds, same).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds", *known)
    return _summed(placed, value, by, n, name)


def _range_of(v: Column, bounds: Sequence[float]) -> Column:
    """How many of the ordered ``bounds`` are less than ``v``, by halves."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def _summed(placed: DataFrame, value: str, by: list[str], n: str, name: str) -> DataFrame:
    """``placed`` with the sums of the counts before each value: of the ranges before its own, and within it."""
    known = {f"_by{i}": c for i, c in enumerate(by)}
    sums = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(k) for k, c in known.items()), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_in", F.coalesce(F.sum(n).over(within), F.lit(0)))
    same = [*(F.col(c).eqNullSafe(F.col(k)) for k, c in known.items()), F.col("_range") == F.col("_r")]
    return out.join(starts, same).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in", "_range", "_r", *known)


def quantiles_of(ranked: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, q): exact linear-interpolation quantiles from (by..., value, n, before)."""
    by = list(by)
    known = {f"_by{i}": c for i, c in enumerate(by)}
    total = ranked.groupBy(*by).agg(F.sum("n").alias("rows")).select(*(F.col(c).alias(k) for k, c in known.items()), "rows")
    both = ranked.join(F.broadcast(total), [F.col(c).eqNullSafe(F.col(k)) for k, c in known.items()]) if by else ranked.join(F.broadcast(total))
    v = F.col(value).cast("double")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), v))

    place = {i: F.lit(float(p)) * (F.col("rows") - 1) for i, p in enumerate(points)}
    aggs = [x for i, p in place.items() for x in (at(F.floor(p)).alias(f"_lo{i}"), at(F.ceil(p)).alias(f"_hi{i}"))]
    got = both.groupBy(*by, "rows").agg(*aggs)
    q = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p)) for i, p in place.items()]
    return got.select(*by, "rows", F.array(*q).alias("q"))


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, q) of the non-null values of a column."""
    return quantiles_of(running(sizes_of(df, value, by), value, by), value, points, by)


def collected(few: DataFrame) -> DataFrame:
    """A table of a few rows, as of one for each column, by value: what is built on it doesn't repeat the work behind it."""
    return few.sparkSession.createDataFrame(few.toArrow())


#: Accuracy of the sketch that brackets an order statistic; a bracket has a few of so many parts of the rows.
ACCURACY = 10_000


def order_statistics(df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]]) -> list[tuple[int, dict[int, float]]]:
    """For each number column how many values it has, and its values of the ranks (from 0) that ``ranks`` names for so many.

    A sketch brackets each rank; then the values below each bracket are counted, and only those within it are grouped and
    ranked. So a column is read three times and no task sorts it."""
    x = [F.col(c).cast("double") for c in columns]
    n = df.agg(*(F.count(v).alias(str(i)) for i, v in enumerate(x))).first() if columns else []
    wanted = [sorted({k for k in ranks(n[i]) if 0 <= k < n[i]}) for i in range(len(x))]
    edges = [sorted({min(1.0, max(0.0, k / max(n[i] - 1, 1) + side * 3 / ACCURACY)) for k in own for side in (-1, 1)}) for i, own in enumerate(wanted)]
    live = [i for i in range(len(x)) if wanted[i]]
    if not live:
        return [(n[i], {}) for i in range(len(x))]
    row = df.agg(*(F.struct(F.min(x[i]).alias("least"), F.max(x[i]).alias("most"), F.percentile_approx(x[i], F.array(*map(F.lit, edges[i])), ACCURACY).alias("q")).alias(str(i)) for i in live)).first()
    brackets = []  # (column, rank, from, to)
    for i in live:
        at = dict(zip(edges[i], row[str(i)]["q"], strict=True))
        for k in wanted[i]:
            share = k / max(n[i] - 1, 1)
            lo, hi = share - 3 / ACCURACY, share + 3 / ACCURACY
            brackets.append((i, k, row[str(i)]["least"] if lo <= 0 else at[lo], row[str(i)]["most"] if hi >= 1 else at[hi]))
    spans = sorted({(i, lo, hi) for i, _, lo, hi in brackets})
    below = df.agg(*(F.count_if(x[i] < lo).alias(str(j)) for j, (i, lo, _) in enumerate(spans))).first()
    hits = F.array_compact(F.array(*(F.when((x[i] >= lo) & (x[i] <= hi), F.struct(F.lit(j).alias("j"), x[i].alias("v"))) for j, (i, lo, hi) in enumerate(spans))))
    inside = df.select(F.explode(hits).alias("h")).groupBy("h.j", "h.v").agg(F.count("*").alias("n"))
    till = Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("till", F.sum("n").over(till))
    place = {span: j for j, span in enumerate(spans)}
    asked = [(place[i, lo, hi], k - below[place[i, lo, hi]]) for i, k, lo, hi in brackets]
    here = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(k).cast("long").alias("k")) for j, k in sorted(set(asked))))
    found = inside.withColumn("a", F.explode(F.filter(here, lambda a: (a["j"] == F.col("j")) & (a["k"] < F.col("till")) & (a["k"] >= F.col("till") - F.col("n"))))).select("j", "a.k", "v").collect()
    value = {(r["j"], r["k"]): r["v"] for r in found}
    out: list[tuple[int, dict[int, float]]] = [(n[i], {}) for i in range(len(x))]
    for (i, k, _, _), a in zip(brackets, asked, strict=True):
        out[i][1][k] = value[a]
    return out


#: Groups up to which facts of each are broadcast to the rows.
FEW_GROUPS = 10_000


def group_medians(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, mid): the exact median of a number column in each group, neither null.

    As ``order_statistics``: a sketch brackets each group's median, so only rows within brackets are grouped and ranked,
    and all of a group with no more rows than ``ACCURACY``. With over ``FEW_GROUPS`` groups all rows are."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_x"))
    edges = F.percentile_approx("_x", F.array(F.lit(0.5 - 3 / ACCURACY), F.lit(0.5 + 3 / ACCURACY)), ACCURACY)
    found = rows.groupBy("_g").agg(F.count("*").alias("rows"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), edges.alias("_q"))
    brackets = collected(found.limit(FEW_GROUPS + 1))
    if brackets.count() > FEW_GROUPS:
        return exact_quantiles(df, value, (0.5,), [by]).where(F.col(by).isNotNull()).select(by, F.col("q")[0].alias("mid"))
    small = F.col("rows") <= ACCURACY
    brackets = brackets.select("_g", "rows", F.when(small, F.col("_least")).otherwise(F.col("_q")[0]).alias("_lo"), F.when(small, F.col("_most")).otherwise(F.col("_q")[1]).alias("_hi"))
    placed = rows.join(F.broadcast(brackets), "_g")
    # what is below a bracket is one row of no value
    cells = placed.where("_x <= _hi").groupBy("_g", "rows", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("n"))
    till = F.sum("n").over(Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = (F.col("rows") - 1) / 2
    at = lambda rank: F.min(F.when(F.col("_till") > rank, F.col("_v")))
    both = cells.withColumn("_till", till).groupBy("_g", "rows").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    return F.broadcast(collected(both.select(F.col("_g").alias(by), (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("mid"))))


def quantile_values(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> list[tuple[int, list[float] | None]]:
    """For each column how many values it has, and its exact linear-interpolation quantiles."""
    found = order_statistics(df, columns, lambda n: [f(p * (n - 1)) for p in points for f in (floor, ceil)])
    out: list[tuple[int, list[float] | None]] = []
    for n, at in found:
        q = []
        for p in points:
            r = p * (n - 1)
            q += [at[floor(r)] + (at[ceil(r)] - at[floor(r)]) * (r - floor(r))] if n else []
        out.append((n, q or None))
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], points: Sequence[float], exact: bool = True) -> DataFrame:
    """(column, rows, q) of the columns that have values; with ``exact`` false by sketches of bounded size. It is taken at
    once, so steps on end don't each repeat those before."""
    if exact:
        got = quantile_values(df, columns, points)
    else:
        arr = F.array(*map(F.lit, map(float, points)))
        row = df.agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(F.col(c).cast("double"), arr, 100_000).alias("q")).alias(str(i)) for i, c in enumerate(columns))).first()
        got = [(row[str(i)]["n"], row[str(i)]["q"]) for i in range(len(columns))]
    rows = [(c, n, q) for c, (n, q) in zip(columns, got, strict=True) if n]
    kinds = pa.schema([("column", pa.string()), ("rows", pa.int64()), ("q", pa.list_(pa.float64()))])
    return df.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds))


def quantile_row(df: DataFrame, columns: Sequence[str], points: Sequence[float], exact: bool = True, name: str = "_q{}") -> DataFrame:
    """One row with an array of quantiles for each column, named by its place; null for a column without values."""
    known = {r["column"]: r["q"] for r in quantile_table(df, columns, points, exact).collect()}
    kinds = pa.schema([(name.format(i), pa.list_(pa.float64())) for i in range(len(columns))])
    return df.sparkSession.createDataFrame(pa.Table.from_pylist([{name.format(i): known.get(c) for i, c in enumerate(columns)}], kinds))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, rank): the average rank of each distinct value; ties share it."""
    return running(sizes_of(df, value, by), value, by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")
