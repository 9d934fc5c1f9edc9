"""Operators over one order of all rows, without a task that walks them all: rows are dealt into ranges of the order between
splitters from a bounded sample, each range is scanned by itself, and what a range passes on to the next ones is one small
row for each range."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import pairwise
from math import ceil, inf, nextafter
from sys import float_info

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from brinework.functions.columns import free_name

#: Rows of a range, about; sampled rows for each range; ranges at most, above which they get larger.
RANGE_ROWS, SAMPLED, RANGES = 500_000, 40, 4096


def _lead(df: DataFrame, column: str) -> Column | None:
    """``column`` as doubles in its order, where lesser doubles are of lesser values: nulls first, NaN as infinity; None for
    columns that are neither numbers nor times."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        day = F.unix_date(x.cast("date"))
        x = day if isinstance(kind, T.DateType) else ((day * 24 + F.hour(x)) * 60 + F.minute(x)).cast("long") * 60 + F.second(x)
    elif not isinstance(kind, (T.NumericType, T.TimestampType)):
        return None
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(inf)), F.lit(-inf)) + F.lit(0.0)  # no negative zero


def dealt(df: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, str, int]:
    """``df`` with a new column of ranges, its name, and how many there are at most: rows of a lesser range come first in ``order`` (nulls
    first), and rows that are equal in it are in one range. The splitters come from rows drawn by seed, about SAMPLED for
    each range; which rows these are moves the sizes of ranges and nothing else. They are one value of the plan, which no row
    carries along. A row is placed by its first column where that is a number or a time and no splitter has the same, and
    else by halves of all splitters."""
    at, name = F.struct(*(F.col(c) for c in order)), free_name(df, "_range")
    rows = df.count()
    n = min(RANGES, ceil(rows / range_rows))
    if n <= 1:
        return df.withColumn(name, F.lit(0)), name, 1
    lead = _lead(df, order[0])
    few = df.select(at.alias("at"), (F.lit(0.0) if lead is None else lead).alias("lead")).where(F.rand(7) < n * SAMPLED / rows)
    placed = few.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")))  # the sample only
    splitters = placed.where((F.col("i") % SAMPLED == 0) & (F.col("i") < n * SAMPLED)).select("at", "lead").distinct()
    row = splitters.agg(F.sort_array(F.collect_list("at")).alias("all"), F.sort_array(F.collect_list("lead")).alias("leads"))
    taken = row.sparkSession.createDataFrame(row.toArrow(), row.schema)
    all_, ends_ = free_name(df, "_splitters"), free_name(df, "_ends")
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    under = F.aggregate(halves, F.lit(0), lambda i, k: F.when(F.get(F.col(all_), i + k - 1) < at, i + k).otherwise(i))
    out, values = df, {all_: taken.select("all").scalar()}
    if lead is not None:
        leads = taken.first()["leads"]
        same = {float_info.max, *leads}  # each starts a part that holds nothing else, or what is beyond all numbers
        edges = sorted({-inf, inf, *same, *(nextafter(e, inf) for e in leads)})
        ends = [None if a in same else bisect_left(leads, b) for a, b in pairwise(edges)]
        out = Bucketizer(splits=edges, inputCol=name, outputCol=ends_).transform(df.withColumn(name, lead)).withColumn(name, F.col(ends_).cast("int"))
        values[ends_] = df.sparkSession.createDataFrame([(ends,)], "ends array<int>").scalar()
        under = F.coalesce(F.get(ends_, F.col(name)), under)
    # each of these is used once, so the plan puts the values into ``under`` and not into rows
    return out.withColumns(values).withColumn(name, under).drop(*values), name, n


def both_ways(by: Sequence[str], order: Sequence[str], value: Column) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the rows up to each row in ``order``, and over those from it on: the latter are the rows up to it in the
    reverse order, as a frame that reaches to the end is gone through anew for every row. Of rows that are equal in the order,
    those without a ``value`` are the last."""
    till = lambda *o: Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    return till(*order, value.isNull()), till(*(F.desc(c) for c in order), value.isNull().desc())


def known(df: DataFrame, value: Column, order: Sequence[str], name: str, forward: bool = True, ahead: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` up to each row in ``order``, or the first from it on where not
    ``forward``; with ``ahead`` both, as ``name`` and ``name + "_ahead"``."""
    ranged, part, n = dealt(df.withColumn(name, value), order, range_rows)
    within, backward = both_ways([part], order, F.col(name))
    at = F.struct(*order)
    sides = [(name, True), (f"{name}_ahead", False)] if ahead else [(name, forward)]
    given = F.when(F.col(name).isNotNull(), at)
    carried = ranged.groupBy(part).agg(F.max_by(name, given).alias("_last"), F.min_by(name, given).alias("_first"))
    ranges = Window.partitionBy(F.lit(0)).orderBy(part)  # a row for each range
    before = F.last("_last", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    after = F.first("_first", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    passed = carried.select(F.col(part).alias("_r"), before, after) if n > 1 else None
    here = {}
    for new, back in sides:
        own = F.last(name, True).over(within if back else backward)
        here[f"_{new}"] = own
    out = ranged.withColumns(here)
    if passed is not None:
        out = out.join(F.broadcast(passed), F.col(part) == F.col("_r"), "left")
    filled = {new: F.coalesce(F.col(f"_{new}"), F.col("_before" if back else "_after")) if passed is not None else F.col(f"_{new}") for new, back in sides}
    return out.withColumns(filled).select(*(c for c in df.columns if c not in filled), *filled)


def places(values: DataFrame, column: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``values`` (distinct in ``column``) with ``name``: 0, 1, ... in their order."""
    ranged, part, n = dealt(values, [column], range_rows)
    own = F.row_number().over(Window.partitionBy(part).orderBy(column)) - 1
    if n == 1:
        return ranged.withColumn(name, own.cast("long")).drop(part)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(part).alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    out = ranged.withColumn(name, own).join(F.broadcast(starts), F.col(part) == F.col("_r"))
    return out.withColumn(name, F.col(name) + F.col("_start")).drop(part, "_r", "_start")
