"""Nearest neighbours of all rows among all rows, exactly, and local outlier factors from them.

Space is cut into cells by a tree of planes that is fitted on a bounded sample; the tree is all that reaches the driver. A
row's own cell tells how far its neighbours can be at most, and only the cells within that distance are asked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.columns import free_name

#: Distinct points of a cell, about; sampled points for each cell; cells at most, above which they get larger.
CELL_POINTS, SAMPLED, CELLS = 256, 16, 65_536


@dataclass(frozen=True)
class Cells:
    """Planes as arrays: the column that is cut (-1 for a cell), where, and the two sides; a cell's number is in ``left``.
    ``few`` are some points, which bound distances where a cell holds too little."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    few: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := self.column[node] >= 0).any():
            at = node[inner]
            node[inner] = np.where(x[inner, self.column[at]] < self.cut[at], self.left[at], self.right[at])
        return self.left[node]

    def within(self, x: np.ndarray, reach: np.ndarray) -> list[list[int]]:
        """For each row the cells that may hold a point at most ``reach`` away."""
        found: list[list[int]] = [[] for _ in x]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.column[node] < 0:
                for i in rows:
                    found[i].append(int(self.left[node]))
                continue
            v, r = x[rows, self.column[node]], reach[rows]
            low, high = rows[v - r < self.cut[node]], rows[v + r >= self.cut[node]]
            todo += [(side, part) for side, part in ((self.left[node], low), (self.right[node], high)) if len(part)]
        return found


def cells_of(few: np.ndarray, n: int, least: int) -> Cells:
    """``n`` cells or fewer: each plane is at the median of the column that varies most among the sampled points. The first
    ``least`` of them and some more are kept."""
    column, cut, left, right, count = [], [], [], [], 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal count
        i = len(column)
        for part in (column, cut, left, right):
            part.append(0)
        spread = few[rows].max(axis=0) - few[rows].min(axis=0) if len(rows) else np.zeros(1)
        if parts <= 1 or spread.max() <= 0:
            column[i], left[i], count = -1, count, count + 1
            return i
        c = int(np.argmax(spread))
        v = few[rows, c]
        middle = np.median(v)
        at = float(middle if (v < middle).any() else v[v > middle].min())
        column[i], cut[i] = c, at
        left[i], right[i] = grow(rows[v < at], parts // 2), grow(rows[v >= at], parts - parts // 2)
        return i

    grow(np.arange(len(few)), n)
    return Cells(np.array(column), np.array(cut, dtype=float), np.array(left), np.array(right), few[: least + 1024])


def points_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, w): the distinct points of rows without nulls or NaN, as arrays, and how many rows each has."""
    x = [F.col(c).cast("double") + F.lit(0.0) for c in columns]  # no negative zeros
    whole = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in x]
    rows = df
    for ok in whole:
        rows = rows.where(ok)
    return rows.groupBy(F.array(*x).alias("at")).agg(F.count("*").alias("w"))


def nearest(points: DataFrame, k: int, dims: int, widest: bool = False) -> DataFrame:
    """(at, w, other, other_w, distance, k_distance): for each of the ``points`` (at, w) the others that are among its ``k``
    nearest rows, all of one distance together, so that ties lose nothing. A point of several rows has its own copies
    first, as ``other`` = ``at`` with one row less. With ``k`` rows or fewer, all others are near. Distances are straight lines, or with
    ``widest`` the greatest of the columns' differences."""
    n, total = points.agg(F.count("*"), F.sum("w")).first()
    k = min(k, (total or 1) - 1)
    cells = min(CELLS, ceil(n / CELL_POINTS))
    wanted = max(cells * SAMPLED, 2 * k + 2)
    share = min(1.0, wanted / max(n, 1))
    drawn = points if share == 1 or n <= 4 * k + 4 else points.where(F.pmod(F.xxhash64("at"), F.lit(2**31)) < int(share * 2**31))
    few = np.array([r["at"] for r in drawn.select("at").sort(F.xxhash64("at")).collect()], dtype=float).reshape(-1, dims)
    shared = points.sparkSession.sparkContext.broadcast(cells_of(few, cells, k))

    @F.pandas_udf("long")
    def cell(at: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(np.stack(at.to_numpy())) if len(at) else np.zeros(0, dtype=np.int64))

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(pdf["at"].to_numpy()), pdf["w"].to_numpy()
        reach = np.zeros(len(x))
        known = shared.value.few
        for a in range(0, len(x), 256):
            part = slice(a, a + 256)
            d = _distances(x[part], x, widest)
            order = np.argsort(d, axis=1, kind="stable")
            till = np.cumsum(w[order], axis=1) - 1  # but for the row itself
            enough = till >= k
            first = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
            own = np.take_along_axis(d, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
            own[~enough.any(axis=1)] = np.inf
            if np.isinf(own).any():  # any k + 1 points, itself perhaps one of them, bound the distance
                far = np.sort(_distances(x[part], known, widest), axis=1)
                own = np.minimum(own, far[:, min(k, far.shape[1] - 1)] if far.shape[1] > k else np.inf)
            reach[part] = own
        reach = reach * (1 + 1e-9) + 1e-300
        return pd.DataFrame({"at": pdf["at"], "w": w, "reach": reach, "cells": shared.value.within(x, reach)})

    placed = points.withColumn("cell", cell("at"))
    queries = placed.groupBy("cell").applyInPandas(asked, "at array<double>, w long, reach double, cells array<long>")
    if widest:
        d = F.array_max(F.zip_with("at", "other", lambda a, b: F.abs(a - b)))
    else:
        d = F.sqrt(F.aggregate(F.zip_with("at", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    others = placed.select("cell", F.col("at").alias("other"), F.col("w").alias("other_w"))
    near = queries.select("at", "w", "reach", F.explode("cells").alias("cell")).join(others, "cell").withColumn("distance", d).where("distance <= reach")
    near = near.withColumn("other_w", F.when(F.col("at") == F.col("other"), F.col("other_w") - 1).otherwise(F.col("other_w"))).where("other_w > 0")
    each = Window.partitionBy("at")
    till = F.sum("other_w").over(each.orderBy("distance"))
    kth = F.min(F.when(F.col("till") >= k, F.col("distance"))).over(each)
    return near.withColumn("till", till).withColumn("k_distance", kth).where("distance <= k_distance").drop("till", "reach", "cell")


def _distances(a: np.ndarray, b: np.ndarray, widest: bool = False) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total = np.maximum(total, np.abs(gap)) if widest else total + gap**2
    return total if widest else np.sqrt(total)


def local_outlier_factor(df: DataFrame, columns: Sequence[str], k: int = 20, name: str = "lof") -> DataFrame:
    """``df`` with ``name``: how much thinner a row's surroundings are than those of its ``k`` nearest rows, about 1 within
    a cluster and more for outliers. All rows of the k-th distance are neighbours, and copies of a row are too. Null for rows with a null, NaN or infinity in
    ``columns``, and where there is one row only. Densities are over the mean reach plus 1e-10, so copies are finite."""
    columns = list(columns)
    near = nearest(points_of(df, columns), k, len(columns))
    reach = near.select(F.col("at").alias("other"), F.col("k_distance").alias("other_k")).distinct()
    share = lambda v: F.sum(F.col("other_w") * v) / F.sum("other_w")
    density = near.join(reach, "other").groupBy("at").agg((1 / (share(F.greatest("distance", "other_k")) + 1e-10)).alias("_density"))
    of_other = density.select(F.col("at").alias("other"), F.col("_density").alias("_other"))
    factor = near.join(of_other, "other").groupBy("at").agg(share(F.col("_other")).alias("_mean")).join(density, "at")
    same, new = free_name(df, "_at"), free_name(df, "_lof")
    factor = factor.select(F.col("at").alias(same), (F.col("_mean") / F.col("_density")).alias(new))
    at = F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in columns))
    kept = [c for c in df.columns if c != name]
    return df.join(factor, at == F.col(same), "left").select(*kept, F.col(new).alias(name))
