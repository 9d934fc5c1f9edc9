"""Predictions of a column from number columns: rows are split by hash, a model is fitted on one part and measured on the
other, and features are ranked by what a shuffle of their values costs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.operators.models import _moments

#: Rows of a block within which values are shuffled, about.
BLOCK_ROWS = 10_000


@dataclass(frozen=True)
class Fitted:
    """A model: what it was fitted for, how it puts ``prediction`` to rows, and what it knows of its features: coefficients,
    with the intercept under the empty name, or the shares of splits. Classes are texts."""

    target: str
    features: tuple[str, ...]
    kind: str
    predict: Callable[[DataFrame], DataFrame]
    known: dict[str, float]


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` hold no null, NaN or infinity."""
    kinds = dict(df.dtypes)
    checks = [F.col(c).isNotNull() & (~F.isnan(c) & (F.abs(c) != float("inf")) if kinds[c] in ("double", "float") else F.lit(True)) for c in columns]
    return df.where(reduce(lambda a, b: a & b, checks))


def split(df: DataFrame, share: float = 0.2, key: Sequence[str] = (), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows): ``share`` of the rows, by a seeded hash of ``key`` or of all columns, are for the test. Rows
    that are equal in it are on one side, whatever the partitions."""
    place = F.pmod(F.xxhash64(F.lit(seed), *(key or df.columns)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(~place), df.where(place)


def fit(train: DataFrame, target: str, features: Sequence[str], kind: str = "regression", model: str = "linear", trees: int = 20, depth: int = 5, seed: int = 42) -> Fitted:
    """A model of complete rows: least squares or a logistic one (``linear``), or a forest (``trees``). Columns that others
    explain fully share their coefficient. A training part without complete rows is an error."""
    if kind not in ("regression", "classification") or model not in ("linear", "trees"):
        raise ValueError("kind must be regression or classification, model linear or trees")
    features = tuple(features)
    rows = complete(train, [target, *features])
    if kind == "regression" and model == "linear":
        known = _least_squares(rows, target, features)
        line = sum((F.col(c).cast("double") * known[c] for c in features), F.lit(known[""]))
        return Fitted(target, features, kind, lambda df: df.withColumn("prediction", line), known)
    if rows.isEmpty():
        raise ValueError("no complete rows to fit on")
    assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features")
    given = lambda df: assembler.transform(df.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(features)}))
    drop = ["_features", "_raw", "_shares", "_class", *(f"_x{i}" for i in range(len(features)))]
    if kind == "regression":
        made = RandomForestRegressor(featuresCol="_features", labelCol="_y", predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed).fit(given(rows.withColumn("_y", F.col(target).cast("double"))))
        return Fitted(target, features, kind, lambda df: made.transform(given(df)).drop(*drop), _shares(made, features))
    index = StringIndexer(inputCol="_t", outputCol="_y", stringOrderType="alphabetAsc").fit(rows.select(F.col(target).cast("string").alias("_t")))
    labelled = index.transform(given(rows.withColumn("_t", F.col(target).cast("string"))))
    names = dict(featuresCol="_features", labelCol="_y", predictionCol="_class", rawPredictionCol="_raw", probabilityCol="_shares")
    made = (LogisticRegression(**names) if model == "linear" else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **names)).fit(labelled)
    classes = F.array(*map(F.lit, index.labels))
    known = _shares(made, features) if model == "trees" else dict(zip(features, np.abs(made.coefficientMatrix.toArray()).max(axis=0).tolist(), strict=True))
    return Fitted(target, features, kind, lambda df: made.transform(given(df)).withColumn("prediction", F.get(classes, F.col("_class").cast("int"))).drop(*drop), known)


def _shares(made, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, map(float, made.featureImportances.toArray()), strict=True))


def _least_squares(rows: DataFrame, target: str, features: Sequence[str]) -> dict[str, float]:
    """Coefficients by cross products of centred columns, which meet on the driver; rows don't."""
    columns = [*features, target]
    means = rows.agg(*(F.avg(F.col(c).cast("double")) for c in columns)).first()
    if means[-1] is None:
        raise ValueError("no complete rows to fit on")
    centred = rows.select(*((F.col(c).cast("double") - F.lit(m)).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, means, strict=True))))
    _, _, cross = _moments(centred, centred.columns)
    scale = np.sqrt(np.diag(cross)[:-1])
    scale[scale == 0] = 1.0
    b = np.linalg.pinv(cross[:-1, :-1] / np.outer(scale, scale), hermitian=True, rcond=1e-12) @ (cross[:-1, -1] / scale) / scale
    return {"": float(means[-1] - b @ np.array(means[:-1], dtype=float)), **{c: float(v) for c, v in zip(features, b, strict=True)}}


def measures(scored: DataFrame, target: str, kind: str = "regression") -> DataFrame:
    """One row of how near ``prediction`` comes: (n, mae, rmse, r2), or (n, accuracy, precision, recall, f1), the last three as
    means over the classes of the rows. r2 is null where the target doesn't vary."""
    return _measured(scored.withColumn("_variant", F.lit(0)), target, kind).drop("_variant")


def _measured(scored: DataFrame, target: str, kind: str) -> DataFrame:
    if kind == "regression":
        y = F.col(target).cast("double")
        off = y - F.col("prediction")
        total = F.var_pop(y) * F.count("*")
        return scored.groupBy("_variant").agg(
            F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"),
            (1 - F.try_divide(F.sum(off * off), F.nullif(total, F.lit(0.0)))).alias("r2"),
        )
    cells = scored.groupBy("_variant", F.col(target).cast("string").alias("y"), F.col("prediction").alias("p")).agg(F.count("*").alias("c"))
    hit = F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)
    # a class is seen from both sides: rows of it, and rows that are said to be of it
    sides = cells.select("_variant", F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("c").alias("own"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("own"), F.col("c").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("_variant", "s.*")
    each = sides.groupBy("_variant", "k").agg(*(F.sum(c).alias(c) for c in ("own", "said", "hit"))).where("own > 0")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("own"))
    return each.groupBy("_variant").agg(F.sum("own").alias("n"), (F.sum("hit") / F.sum("own")).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(ratio(2 * p * r, p + r)).alias("f1"))


def permutation_importance(fitted: Fitted, test: DataFrame, key: Sequence[str] = (), block: Column | None = None, order: Sequence[Column] = (), seed: int = 42) -> DataFrame:
    """(feature, importance, share, rank): how much worse the model does where a feature's values are those of other rows: the
    rise of the mean squared error, or the loss of accuracy; the share is of all rises above zero.

    Rows are dealt by a seeded hash of ``key``, or of all columns, into blocks of some ten thousand, and each takes the
    value of the next row of its block by hash: a permutation of all rows that no task holds whole. Rows of all variants
    are scored together. ``block`` and ``order`` may be given instead of the hash."""
    rows = complete(test, [fitted.target, *fitted.features])
    if block is None:
        blocks = max(1, ceil(rows.count() / BLOCK_ROWS))
        block = F.pmod(F.xxhash64(F.lit(seed), *(key or test.columns)), F.lit(blocks))
        order = [F.xxhash64(F.lit(seed + 1), *(key or test.columns))]
    whole = rows.select(F.col(fitted.target).alias("_y"), *(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(fitted.features)), block.alias("_block"), F.struct(*order).alias("_order"))
    within = Window.partitionBy("_block").orderBy("_order", *(f"_f{i}" for i in range(len(fitted.features))), "_y")
    first = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = range(len(fitted.features))
    moved = whole.withColumns({f"_m{i}": F.coalesce(F.lead(f"_f{i}").over(within), F.first(f"_f{i}").over(first)) for i in at})
    variants = F.array(*(F.struct(F.lit(v).alias("_variant"), *(F.col(f"_m{i}" if i == v else f"_f{i}").alias(c) for i, c in enumerate(fitted.features))) for v in (-1, *at)))
    scored = fitted.predict(moved.select(F.col("_y").alias(fitted.target), F.explode(variants).alias("_v")).select(fitted.target, "_v.*"))
    found = {r["_variant"]: r for r in _measured(scored, fitted.target, fitted.kind).collect()}  # a row for each feature
    if -1 not in found:
        return test.sparkSession.createDataFrame([], "feature string, importance double, share double, rank int")
    cost = (lambda r: r["rmse"] ** 2) if fitted.kind == "regression" else (lambda r: -r["accuracy"])
    rises = sorted(((float(cost(found[i]) - cost(found[-1])), c) for i, c in enumerate(fitted.features)), key=lambda r: (-r[0], r[1]))
    total = sum(max(v, 0.0) for v, _ in rises)
    return test.sparkSession.createDataFrame([(c, v, max(v, 0.0) / total if total else 0.0, i) for i, (v, c) in enumerate(rises, 1)], "feature string, importance double, share double, rank int")
