"""Outliers of rows: an isolation forest whose trees come from bounded seeded samples, every row scored on the executors;
noise of a density clustering; and one entry to all methods."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.columns import long_form, numeric
from brinework.operators.profile import iqr_outliers, zscore_outliers


#: Boxes of a tree that is read off a table, at most; an index of them has two bytes.
TABLE = 65_536


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: the feature split on (-1 for a leaf), the threshold, the children, and a leaf's path length."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int

    @cached_property
    def tables(self) -> tuple[list[np.ndarray], list[tuple[list[np.ndarray], np.ndarray] | None]]:
        """All cuts of each feature; and for each tree what each place between them adds to an index, and the path length by
        that index. None for a tree whose cuts part space into over ``TABLE`` boxes, which is walked."""
        p = 1 + max((int(f.max()) for f, *_ in self.trees), default=-1)
        cuts = [np.unique(np.concatenate([c[f == j] for f, c, *_ in self.trees])) for j in range(p)]
        out: list[tuple[list[np.ndarray], np.ndarray] | None] = []
        for tree in self.trees:
            own = [np.unique(tree[1][tree[0] == j]) for j in range(p)]
            boxes = math.prod(len(u) + 1 for u in own)
            if boxes > TABLE:
                out.append(None)
                continue
            corner = np.meshgrid(*(np.append(-np.inf, u) for u in own), indexing="ij")
            path = _walked(tree, np.column_stack([c.ravel() for c in corner])) if p else np.array([tree[4][0]])
            steps = [math.prod(len(u) + 1 for u in own[j + 1 :]) for j in range(p)]
            out.append(([(np.append(0, np.cumsum(np.isin(c, u))) * n).astype(np.uint16) for c, u, n in zip(cuts, own, steps, strict=True)], path))
        return cuts, out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what is isolated soon. A row's places among the cuts of the features
        are found once, and a tree reads its path length off them."""
        cuts, tables = self.tables
        places = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
        total = np.zeros(len(x))
        for tree, table in zip(self.trees, tables, strict=True):
            if table is None:
                total += _walked(tree, x)
                continue
            at = np.zeros(len(x), dtype=np.uint16)
            for place, adds in zip(places, table[0], strict=True):
                at += adds[place]
            total += table[1][at]
        return 2.0 ** (-total / len(self.trees) / max(expected_path(self.size), 1e-9))


def _walked(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The path length of each row."""
    feature, cut, left, right, path = tree
    node = np.zeros(len(x), dtype=np.int64)
    while (inner := feature[node] >= 0).any():
        at = node[inner]
        node[inner] = np.where(x[inner, feature[at]] < cut[at], left[at], right[at])
    return path[node]


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n``."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, most: int):
    feature, cut, left, right, path = [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        i = len(feature)
        for column in (feature, cut, left, right, path):
            column.append(0)
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if depth >= most or len(rows) < 2 or not len(varied):
            feature[i], path[i] = -1, depth + expected_path(len(rows))
            return i
        f = int(rng.choice(varied))
        feature[i], cut[i] = f, rng.uniform(lo[f], hi[f])
        below = x[rows, f] < cut[i]
        left[i], right[i] = grow(rows[below], depth + 1), grow(rows[~below], depth + 1)
        return i

    grow(np.arange(len(x)), 0)
    return tuple(map(np.array, (feature, cut, left, right, path)))


def fit(df: DataFrame, columns: list[str] | None = None, trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    """A forest of complete rows. The rows the trees are drawn from, trees * sample at most, are those of least seeded
    hash; nothing else reaches the driver."""
    columns = columns or numeric(df)
    full = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    few = full.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    size = min(sample, len(few))
    if not size:
        return Forest([], 0)
    return Forest([_tree(few[rng.choice(len(few), size, replace=False)], rng, math.ceil(math.log2(max(size, 2)))) for _ in range(trees)], size)


def score(df: DataFrame, forest: Forest, columns: list[str], name: str = "anomaly") -> DataFrame:
    """``df`` with the score of each complete row; null for others."""
    forest.tables  # once, on the driver, and shared with the trees
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=np.float64) for p in parts])
        good = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if shared.value.trees:
            out[good] = shared.value.scores(x[good])
        return pd.Series(out)

    return df.withColumn(name, F.nanvl(of(*(F.col(c).cast("double") for c in columns)), F.lit(None)))


def flags(df: DataFrame, columns: list[str] | None = None, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``anomaly`` and ``is_anomaly``: scores over the (1 - contamination) percentile of all."""
    columns = columns or numeric(df)
    scored = score(df, fit(df, columns, seed=seed), columns)
    cut = scored.agg(F.percentile_approx("anomaly", 1 - contamination, 10_000).alias("_cut"))
    return scored.join(F.broadcast(cut)).withColumn("is_anomaly", F.coalesce(F.col("anomaly") > F.col("_cut"), F.lit(False))).drop("_cut")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, anomaly_mean, normal_mean, anomaly_std, difference) of rows with ``is_anomaly``."""
    odd = F.coalesce(F.col("is_anomaly"), F.lit(False))
    cells = long_form(df.where("anomaly is not null").withColumn("_odd", odd), columns, keep=["_odd"])
    x = F.when(F.col("_odd"), F.col("value"))
    got = cells.groupBy("column").agg(F.avg(x).alias("anomaly_mean"), F.avg(F.when(~F.col("_odd"), F.col("value"))).alias("normal_mean"), F.stddev_samp(x).alias("anomaly_std"))
    return got.withColumn("difference", F.abs(F.col("anomaly_mean") - F.col("normal_mean")))


def totals(df: DataFrame, least: int = 50) -> DataFrame:
    """(samples, anomalies, percent, min_score, max_score, mean_score, extreme, high, moderate) of rows with a score; no
    row for under ``least`` of them. Scores are negated, as is common: under -0.5 is extreme, under -0.3 high, under -0.1
    moderate."""
    s = -F.col("anomaly")
    one = df.where("anomaly is not null").agg(
        F.count("*").alias("samples"), F.count_if("is_anomaly").alias("anomalies"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"),
        F.count_if(s < -0.5).alias("extreme"), F.count_if((s >= -0.5) & (s < -0.3)).alias("high"), F.count_if((s >= -0.3) & (s < -0.1)).alias("moderate"),
    )
    return one.where(F.col("samples") >= least).withColumn("percent", F.col("anomalies") * 100.0 / F.col("samples"))


#: Columns of the grid that density clustering looks around in, at most.
GRID = 3


def dbscan_noise(df: DataFrame, columns: list[str], eps: float = 0.5, min_samples: int = 5, name: str = "is_noise") -> DataFrame:
    """``df`` with the rows that a density clustering leaves over: those with fewer than ``min_samples`` rows within
    ``eps``, themselves included, and none with that many within ``eps``. The columns have no nulls.

    Distinct points lie in cells whose diagonal is ``eps``. Where a cell has enough rows all are dense, and nothing is
    compared. The few points of other cells are compared with those of the cells around, in a grid of at most ``GRID``
    columns, those that ``eps`` parts most: what is near is near in any of the columns, and whether it is near is told by
    all of them. Those left open after that, neither dense nor near a point of a dense cell, look for dense points once more."""
    d = len(columns)
    p, q = [f"_p{i}" for i in range(d)], [f"_q{i}" for i in range(d)]
    points = df.groupBy(*(F.col(c).cast("double").alias(x) for c, x in zip(columns, p, strict=True))).agg(F.count("*").alias("_w"))
    spread = points.agg(*(F.coalesce(F.max(x) - F.min(x), F.lit(0.0)).alias(x) for x in p)).first()
    grid = sorted(p, key=lambda x: (-spread[x], x))[:GRID]

    def cell(of: list[str], side: float):
        return F.array(*(F.floor(F.col(x) / side).cast("long") for x in of))

    side = eps / math.sqrt(len(grid)) * (1 - 1e-12)
    points = points.withColumn("_small", cell(p, eps / math.sqrt(d) * (1 - 1e-12))).withColumn("_cell", cell(grid, side))
    crowded = points.groupBy("_small").agg(F.sum("_w").alias("_m"))
    points = points.join(crowded.hint("merge"), "_small").withColumn("_dense", F.col("_m") >= min_samples)
    k = len(grid)
    reach = math.ceil(math.sqrt(k))
    around = [o for o in itertools.product(range(-reach, reach + 1), repeat=k) if sum(max(abs(x) - 1, 0) ** 2 for x in o) < k]
    offsets = F.array(*(F.array(*(F.lit(x).cast("long") for x in o)) for o in around))
    close = sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(p, q, strict=True)), F.lit(0.0)) <= eps * eps

    # Sizes after an explode or a join are unknown to the planner, which would take some of these sides for small ones and
    # gather them on the driver: merge joins keep rows in tasks.
    def looked_at(rows: DataFrame, others: DataFrame) -> DataFrame:
        """``rows`` (p..., _own) with the ``others`` (q..., _cell, ...) within ``eps``; cells without points are not asked."""
        there = others.select("_cell").distinct()
        pairs = rows.select("_own").distinct().withColumn("_o", F.explode(offsets)).select("_own", F.zip_with("_own", "_o", lambda a, b: a + b).alias("_cell"))
        return rows.join(pairs.join(there.hint("merge"), "_cell", "left_semi").hint("merge"), "_own").join(others.hint("merge"), "_cell").where(close)

    as_q = [F.col(a).alias(b) for a, b in zip(p, q, strict=True)]
    near = looked_at(points.where("not _dense").select(*p, F.col("_cell").alias("_own")), points.select("_cell", "_w", "_dense", *as_q))
    state = F.when(F.sum("_w") >= min_samples, 2).when(F.max("_dense"), 1).otherwise(0)
    told = near.groupBy(*p).agg(state.alias("_state")).withColumn("_cell", cell(grid, side))
    open_ = told.where("_state = 0").select(*p, F.col("_cell").alias("_own"))
    reached = looked_at(open_, told.where("_state = 2").select("_cell", *as_q)).select(*p).distinct()
    noise = told.where("_state = 0").select(*p).join(reached.hint("merge"), p, "left_anti").withColumn("_noise", F.lit(True)).hint("merge")
    same = [F.col(c).cast("double") == F.col(x) for c, x in zip(columns, p, strict=True)]
    return df.join(noise, same, "left").withColumn(name, F.coalesce("_noise", F.lit(False))).drop(*p, "_noise")


def by_all_methods(df: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Outliers by every method, and the consensus: the tables that ``detect`` gives for iqr, zscore, isolation_forest and all."""
    return {"consensus" if m == "all" else m: detect(df, m, columns) for m in ("iqr", "zscore", "isolation_forest", "all")}


def detect(df: DataFrame, method: str = "all", columns: list[str] | None = None) -> DataFrame:
    """Outliers by one entry: (column, ...) of iqr or zscore, (samples, ...) of isolation_forest, or for all the columns
    that both iqr and zscore look at: (column, iqr_outliers, zscore_outliers, agreement), high where the counts differ by
    under ten."""
    columns = columns or numeric(df)
    if method == "iqr":
        return iqr_outliers(df, columns)
    if method == "zscore":
        return zscore_outliers(df, columns)
    if method == "isolation_forest":
        return totals(flags(df, columns))
    if method != "all":
        raise ValueError("method must be iqr, zscore, isolation_forest or all")
    both = iqr_outliers(df, columns).select("column", F.col("total").alias("iqr_outliers")).join(zscore_outliers(df, columns).select("column", F.col("total").alias("zscore_outliers")), "column")
    return both.withColumn("agreement", F.when(F.abs(F.col("iqr_outliers") - F.col("zscore_outliers")) < 10, "high").otherwise("low"))
