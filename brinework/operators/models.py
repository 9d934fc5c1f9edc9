"""Multicollinearity, principal components, clustering, mutual information, mixtures. Matrices of columns by columns
meet on the driver; rows never do."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinework.functions.columns import free_name, numeric


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of complete rows, in one pass. The columns bound their size."""
    full = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    k = len(columns)
    one = full.agg(F.count("*"), *(F.sum(c) for c in columns), *(F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k))).first()
    n, sums = one[0], np.array([one[1 + i] or 0.0 for i in range(k)])
    cross, at = np.zeros((k, k)), 1 + k
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = one[at] or 0.0
            at += 1
    return n, sums, cross


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, vif, severity) on complete rows without an intercept; columns that do not vary are left out."""
    columns = columns or numeric(df)
    n, sums, cross = _moments(df, columns)
    var = np.diag(cross) - sums * sums / max(n, 1)
    live = [i for i in range(len(columns)) if var[i] > 1e-12 * max(cross[i, i], 1e-300)]
    schema = "column string, vif double, severity string"
    if len(live) < 2:
        return df.sparkSession.createDataFrame([], schema)
    x = cross[np.ix_(live, live)]
    scale = np.sqrt(np.diag(x))
    x = x / np.outer(scale, scale)
    rows = []
    for i, c in enumerate(live):
        rest = [j for j in range(len(live)) if j != i]
        left = 1 - float(x[i, rest] @ np.linalg.pinv(x[np.ix_(rest, rest)], hermitian=True) @ x[rest, i])
        rows.append((columns[c], 1 / left if left > 1e-12 else float("inf")))
    return df.sparkSession.createDataFrame([(c, v, "high" if v > 10 else "moderate" if v > 5 else "low") for c, v in sorted(rows, key=lambda r: -r[1])], schema)


def pca(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(component, variance, ratio, cumulative, loadings) of standardized complete rows; the largest loading of each
    component is positive."""
    columns = columns or numeric(df)
    n, sums, cross = _moments(df, columns)
    if n < 2:
        return df.sparkSession.createDataFrame([], "component int, variance double, ratio double, cumulative double, loadings map<string,double>")
    cov = cross / n - np.outer(sums, sums) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    live = [i for i in range(len(columns)) if sd[i] > 0]
    corr = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    rows, total = [], 0.0
    for i, v in enumerate(values):
        w = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        total += v / values.sum()
        rows.append((i + 1, float(v * n / (n - 1)), float(v / values.sum()), float(total), {columns[c]: float(w[j]) for j, c in enumerate(live)}))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, cumulative double, loadings map<string,double>")


def pca_summary(components: DataFrame) -> DataFrame:
    """(for_90, for_95, for_99, components, reduction_95): how many components keep so many percent of the variance, and
    by how many percent that shortens the rows."""
    need = lambda t: (F.count_if(F.col("cumulative") < t - 1e-12) + 1).cast("int")
    one = components.agg(need(0.90).alias("for_90"), need(0.95).alias("for_95"), need(0.99).alias("for_99"), F.count("*").alias("components"))
    return one.withColumn("reduction_95", (1 - F.col("for_95") / F.col("components")) * 100)


def pca_top_features(components: DataFrame, most: int = 5) -> DataFrame:
    """(component, rank, feature, loading) of the ``most`` largest loadings of the first ``most`` components."""
    each = components.where(F.col("component") <= most).select("component", F.explode("loadings").alias("feature", "loading"))
    order = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    full = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    stats = full.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
    return full.select(*(((F.col(c) - F.lit(stats[c]["m"] or 0.0)) / F.lit(stats[c]["s"] or 1.0)).alias(c) for c in columns))


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(_standardized(df, columns)).select("features")


#: Rows that starts are drawn from, those of least hash; rounds of a fit at most, and the squared way of all its centres
#: under which it ends.
SEED_ROWS, ROUNDS, STILL = 2000, 300, 1e-4

#: Cells at most that sum up all rows for the starts; fewer distinct rows stand for themselves.
CELLS = 1 << 17


def _seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` starts, each drawn by its squared distance from those before."""
    chosen = [x[rng.integers(len(x))]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        chosen.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _assigned(x: np.ndarray, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nearest centre and its squared distance, for each set of centres."""
    square, out = (x * x).sum(axis=1), []
    for c in centres:
        d = square[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
        own = np.argmin(d, axis=1)
        out.append((own, np.maximum(d[np.arange(len(x)), own], 0)))
    return out


#: Distances of the rows that meet all centres at once, about: they stay in a core's cache.
BLOCK = 1 << 17


def _sums(x: np.ndarray, w: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of centres a row for each centre: the weight of the rows nearest to it, their summed squared distance
    and their sums. A block of rows meets the centres of all sets in one product, and its sums are another."""
    ends, every, runs, at = np.cumsum([0, *(len(c) for c in centres)]), np.vstack(centres), [], 0
    for k, same in itertools.groupby(map(len, centres)):
        m = len(list(same))
        runs.append((at, m, k))
        at += m * k
    square = (every * every).sum(axis=1)
    turned, acc = np.column_stack([-2 * every, square]), np.zeros((len(every), x.shape[1] + 2))
    step = max(1, min(BLOCK // len(every), len(x)))
    held = np.empty((2, len(every), step))  # fresh memory for every block would take longer than the products
    for at in range(0, len(x), step):
        some, weight = x[at : at + step], w[at : at + step, None]
        one = np.ones((len(some), 1))
        d, chosen = held[:, :, : len(some)]
        np.matmul(turned, np.hstack([some, one]).T, out=d)
        # sets of one size stand together; rows stand along the last axis, so a minimum goes over whole lines of them
        for a, m, k in runs:
            each = d[a : a + m * k].reshape(m, k, -1)
            mine = each == each.min(axis=1, keepdims=True)
            if np.count_nonzero(mine) != m * len(some):  # of equal distances the first counts
                mine = each.argmin(axis=1)[:, None] == np.arange(k)[None, :, None]
            chosen[a : a + m * k] = mine.reshape(m * k, -1)
        acc += chosen @ (np.hstack([one, (some * some).sum(axis=1, keepdims=True), some]) * weight)
    acc[:, 1] = np.maximum(acc[:, 1] - 2 * (acc[:, 2:] * every).sum(axis=1) + acc[:, 0] * square, 0)
    return [acc[a:b] for a, b in zip(ends, ends[1:])]


def _means(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Where the rows of ``_sums`` have their means; a centre without rows stays."""
    return np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), centres)


def _edges(few: np.ndarray) -> list[np.ndarray]:
    """Where each column is cut, so that all together make at most ``CELLS`` cells: at its quantiles among ``few`` rows. A
    column of few values is cut between them and leaves more cuts to the others."""
    out, left = [np.zeros(0)] * few.shape[1], float(CELLS)
    values = [np.unique(v) for v in few.T]
    for done, j in enumerate(sorted(range(few.shape[1]), key=lambda j: len(values[j]))):
        parts = max(1, min(len(values[j]), int(left ** (1 / (few.shape[1] - done)) + 1e-9)))
        left /= parts
        v = values[j] if parts == len(values[j]) else np.unique(np.quantile(few[:, j], np.arange(1, parts) / parts))
        out[j] = (v[1:] + v[:-1]) / 2 if parts == len(values[j]) else v
    return out


def _cells(data: DataFrame, columns: list[str], weight: str, few: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and weights of all rows in at most ``CELLS`` cells; ``few`` of the ``n`` distinct ones tell where they are cut."""
    p = len(columns)
    if n <= CELLS:
        rows = data.orderBy(*columns).toPandas()
        return rows[columns].to_numpy(dtype=np.float64), rows[weight].to_numpy(dtype=np.float64)
    edges = _edges(few)
    shape = [len(e) + 1 for e in edges]

    def run(batches):
        acc = np.zeros((p + 1, int(np.prod(shape))))
        for pdf in batches:
            x, w = pdf[columns].to_numpy(dtype=np.float64), pdf[weight].to_numpy(dtype=np.float64)
            own = np.ravel_multi_index([np.searchsorted(e, v) for e, v in zip(edges, x.T, strict=True)], shape)
            for j in range(p + 1):
                acc[j] += np.bincount(own, weights=w * x[:, j] if j < p else w, minlength=acc.shape[1])
        full = np.flatnonzero(acc[p])
        yield pd.DataFrame({"cell": full, **{f"s{j}": acc[j, full] for j in range(p + 1)}})

    sums = [f"s{j}" for j in range(p + 1)]
    got = data.mapInPandas(run, "cell long, " + ", ".join(f"{s} double" for s in sums)).groupBy("cell").agg(*(F.sum(s).alias(s) for s in sums)).orderBy("cell").toPandas()[sums].to_numpy()
    return got[:, :p] / got[:, p:], got[:, p]


def _settled(spark: SparkSession, cells: tuple[np.ndarray, np.ndarray], centres: list[np.ndarray]) -> list[np.ndarray]:
    """Each set of centres after a fit to the cells: a task for each set, in one job."""
    shared = spark.sparkContext.broadcast((*cells, centres))

    def run(batches):
        x, w, held = shared.value
        for pdf in batches:
            for i in pdf["id"]:
                c = held[i]
                for _ in range(ROUNDS):
                    before, c = c, _means(_sums(x, w, [c])[0], c)
                    if ((c - before) ** 2).sum() <= STILL / 100:
                        break
                yield pd.DataFrame({"i": i, "j": range(len(c)), **{f"s{q}": c[:, q] for q in range(c.shape[1])}})

    sums = [f"s{q}" for q in range(centres[0].shape[1])]
    out = [np.zeros(c.shape) for c in centres]
    for r in spark.range(0, len(centres), 1, len(centres)).mapInPandas(run, "i long, j long, " + ", ".join(f"{s} double" for s in sums)).collect():
        out[r["i"]][r["j"]] = r[2:]
    shared.destroy()
    return out


def kmeans(df: DataFrame, columns: list[str] | None = None, ks: range = range(2, 11), starts: int = 10, seed: int = 42, least: int = 50) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, sizes, balance, best, best_davies_bouldin, elbow) for each number of
    clusters of standardized complete rows; no row for under ``least`` of them.

    Starts are drawn from a few rows and settle among the means of cells that sum up all rows, so that few passes over
    the rows are left. All starts of all k are then fitted together: a pass over the rows assigns them to every set of
    centres and gives a sum for each centre, so passes are shared and only centres and cells reach the driver. No start
    ends before it stands still among the rows themselves. Of each k the start of least inertia counts. Silhouettes are by squared distances, which sums of a cluster give in closed form. Ties go to the smaller k."""
    columns = columns or numeric(df)
    spark, schema = df.sparkSession, "k int, inertia double, silhouette double, davies_bouldin double, sizes array<long>, balance double, best boolean, best_davies_bouldin boolean, elbow boolean"
    data, p, weight = _standardized(df, columns), len(columns), free_name(df, "_weight")
    data = data.groupBy(*columns).agg(F.count("*").alias(weight)).persist()
    n, distinct = data.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    ks = [k for k in ks if k < n]
    if n < least or not ks:
        data.unpersist()
        return spark.createDataFrame([], schema)
    few = data.orderBy(F.xxhash64(*columns), *columns).limit(SEED_ROWS).toPandas()
    few = np.repeat(few[columns].to_numpy(dtype=np.float64), few[weight].clip(upper=SEED_ROWS), axis=0)[:SEED_ROWS]
    rng = np.random.default_rng(seed)
    owner = [k for k in ks for _ in range(starts)]
    centres = _settled(spark, _cells(data, columns, weight, few, distinct), [_seeded(few, k, rng) for k in owner])
    sums = ", ".join(f"s{i} double" for i in range(p))

    def total(live: list[int], held: list[np.ndarray]) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(held)

        def run(batches):
            acc = [np.zeros((len(c), p + 2)) for c in shared.value]
            for pdf in batches:
                for a, more in zip(acc, _sums(pdf[columns].to_numpy(dtype=np.float64), pdf[weight].to_numpy(dtype=np.float64), shared.value), strict=True):
                    a += more
            rows = [(i, j, *row) for i, a in enumerate(acc) for j, row in enumerate(a) if row[0]]
            yield pd.DataFrame(rows, columns=["i", "j", "n", "cost", *(f"s{q}" for q in range(p))])

        got = data.mapInPandas(run, f"i long, j long, n double, cost double, {sums}").groupBy("i", "j").agg(F.sum("n"), F.sum("cost"), *(F.sum(f"s{q}") for q in range(p))).collect()
        shared.destroy()
        out = {i: np.zeros((len(held[at]), p + 2)) for at, i in enumerate(live)}
        for r in got:
            out[live[r["i"]]][r["j"]] = list(r)[2:]
        return out

    live, inertia = list(range(len(centres))), np.full(len(centres), np.inf)
    for _ in range(ROUNDS):
        found, still = total(live, [centres[i] for i in live]), []
        for i in live:
            a = found[i]
            new = _means(a, centres[i])
            inertia[i] = a[:, 1].sum()
            if ((new - centres[i]) ** 2).sum() > STILL:
                still.append(i)
            centres[i] = new
        live = still
        if not live:
            break
    best = {k: min((i for i, o in enumerate(owner) if o == k), key=lambda i: (inertia[i], i)) for k in ks}
    chosen = [centres[best[k]] for k in ks]
    last = total(list(range(len(ks))), chosen)
    scores = _cluster_scores(data, columns, weight, chosen, last)
    data.unpersist()
    cost = [float(last[i][:, 1].sum()) for i in range(len(ks))]
    sil, db = [float(s) for s, _ in scores], [float(d) for _, d in scores]
    bend = np.diff(np.diff(cost)) if len(ks) >= 3 else np.zeros(0)
    elbow = ks[int(np.argmax(bend)) + 1] if len(bend) else ks[int(np.argmax(sil))]
    rows = []
    for i, k in enumerate(ks):
        sizes = last[i][:, 0]
        full = sizes[sizes > 0]
        rows.append((k, cost[i], sil[i], db[i], [int(s) for s in sizes], float(full.min() / full.max()), i == int(np.argmax(sil)), i == int(np.argmin(db)), k == elbow))
    return spark.createDataFrame(rows, schema)


def _cluster_scores(data: DataFrame, columns: list[str], weight: str, centres: list[np.ndarray], sums: dict[int, np.ndarray]) -> list[tuple[float, float]]:
    """(silhouette, Davies-Bouldin) of each set of centres over weighted rows, in one pass."""
    stats = []
    for i, c in enumerate(centres):
        n = sums[i][:, 0]
        mean = np.where(n[:, None] > 0, sums[i][:, 2:] / np.maximum(n[:, None], 1), c)
        spread = np.where(n > 0, (sums[i][:, 1] / np.maximum(n, 1)) - ((mean - c) ** 2).sum(axis=1), 0)
        stats.append((c, n, mean, np.maximum(spread, 0)))
    shared = data.sparkSession.sparkContext.broadcast(stats)

    def run(batches):
        acc = [(np.zeros(1), np.zeros(len(c))) for c, _, _, _ in shared.value]
        for pdf in batches:
            x, w = pdf[columns].to_numpy(dtype=np.float64), pdf[weight].to_numpy(dtype=np.float64)
            for (total, far), (own, _), (_, n, mean, spread) in zip(acc, _assigned(x, [s[0] for s in shared.value]), shared.value, strict=True):
                d = (x * x).sum(axis=1)[:, None] - 2 * x @ mean.T + (mean * mean).sum(axis=1)
                # mean squared distance to all rows of a cluster: to its centre, and theirs to it
                each = np.where(n > 0, np.maximum(d, 0) + spread, np.inf)
                rows = np.arange(len(x))
                mine = each[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
                each[rows, own] = np.inf
                other = each.min(axis=1)
                most = np.maximum(mine, other)
                total += (w * np.where((n[own] > 1) & (most > 0), (other - mine) / np.where(most > 0, most, 1), 0)).sum()
                far += np.bincount(own, weights=w * np.sqrt(np.maximum(d[rows, own], 0)), minlength=len(far))
        rows = [(i, -1, float(t[0])) for i, (t, _) in enumerate(acc)] + [(i, j, float(v)) for i, (_, f) in enumerate(acc) for j, v in enumerate(f)]
        yield pd.DataFrame(rows, columns=["i", "j", "v"])

    got = {(r["i"], r["j"]): r["v"] for r in data.mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    shared.destroy()
    out = []
    for i, (_, n, mean, _) in enumerate(stats):
        full = np.flatnonzero(n > 0)
        s = np.array([got[i, j] / n[j] for j in full])
        gap = np.sqrt(((mean[full][:, None] - mean[full][None]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        worst = ((s[:, None] + s[None]) / np.where(gap > 0, gap, np.inf)).max(axis=1) if len(full) > 1 else np.zeros(1)
        out.append((got[i, -1] / max(n.sum(), 1), float(worst.mean())))
    return out


def mixture(df: DataFrame, k: int = 3, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(cluster, weight) of a Gaussian mixture."""
    model = GaussianMixture(k=k, seed=seed).fit(_vectors(df, columns or numeric(df)))
    return df.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "cluster int, weight double")


def hierarchy(df: DataFrame, k: int = 4, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(cluster, n) of bisecting k-means."""
    data = _vectors(df, columns or numeric(df))
    return BisectingKMeans(k=k, seed=seed).fit(data).transform(data).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, information, importance, band): information in nats between equal-width bins of a number feature, or
    the values of another, and the target, binned likewise where it is a number of 20 values or more."""
    num = set(numeric(df))
    many = target in num and df.select(target).distinct().limit(20).count() == 20
    wide = [c for c in [*features, *([target] if many else [])] if c in num]
    ends = df.agg(*(F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in wide)).first() if wide else {}

    def binned(c):
        if c not in wide:
            return F.col(c).cast("string")
        lo, hi = ends[c]["lo"], ends[c]["hi"]
        if lo is None or hi <= lo:
            return F.when(F.col(c).isNotNull(), "0")
        return F.least(F.floor((F.col(c).cast("double") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("string")

    cells = df.select(binned(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), binned(c).alias("x")) for c in features))).alias("f")).select("y", "f.*").where("x is not null and y is not null").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("all"))
    px, py = cells.groupBy("feature", "x").agg(F.sum("n").alias("nx")), cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    joined = cells.join(px, ["feature", "x"]).join(py, ["feature", "y"]).join(F.broadcast(total), "feature")
    mi = joined.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny"))))).alias("information"))
    out = mi.join(F.broadcast(mi.agg(F.max("information").alias("most")))).withColumn("importance", F.coalesce(F.try_divide("information", F.nullif("most", F.lit(0.0))), F.lit(0.0))).drop("most")
    return out.withColumn("band", F.when(F.col("importance") > 0.7, "high").when(F.col("importance") > 0.3, "medium").otherwise("low"))


def mahalanobis(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(key..., distance): each complete row's distance from the mean by the covariance of all; null for one row."""
    n, sums, cross = _moments(df, columns)
    if n < 2:  # no covariance
        return df.na.drop(subset=columns).select(*key, F.lit(None).cast("double").alias("distance"))
    mean = sums / n
    inverse = np.linalg.pinv((cross - n * np.outer(mean, mean)) / (n - 1))
    d = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean, strict=True)]
    square = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.na.drop(subset=columns).select(*key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))
