"""Mutual information between number columns and a target by distances to nearest rows, after Kraskov, Stögbauer and
Grassberger (2004) for number targets and Ross (2014) for classes. No values are put into bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinework.functions.columns import numeric
from brinework.operators.neighbours import nearest
from brinework.operators.ranges import places
from brinework.operators.ranks import running

#: Points of a block of the order by class and value; each class's number of rows is repeated this often, so that a class
#: with most rows is joined in as many parts.
BLOCK, PARTS = 4096, 16


def digamma(n: Column) -> Column:
    """The digamma function of a count of 1 or more, to some 1e-12: its series from 8 on, and steps down from there."""
    x = F.greatest(n, F.lit(8)).cast("double")
    s = 1 / (x * x)
    series = F.ln(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return series - F.aggregate(F.sequence(F.least(n, F.lit(8)).cast("int"), F.lit(8)), F.lit(0.0), lambda a, i: a + F.when(i < 8, 1.0 / i).otherwise(0.0))


def _under(distance: Column, *at: Column) -> Column:
    """A radius that leaves out what lies at ``distance`` itself; distances that differ by rounding only are equal."""
    slack = sum((F.abs(x) for x in at), distance) * 8e-15
    return F.greatest(F.lit(0.0), distance - slack)


def _within(values: DataFrame, asked: DataFrame, x: str, radius: str, name: str) -> DataFrame:
    """``asked`` with ``name``: how many of the ``values`` (v, n) lie within ``radius`` of ``x``. The ends of all intervals are
    merged into the order of the values, so each end reads off how many values come before it."""
    lo, hi = F.col(x) - F.col(radius), F.col(x) + F.col(radius)
    ends = asked.select(F.explode(F.array(lo, hi)).alias("v")).select("v", F.lit(0).cast("long").alias("n"))
    at = running(values.select("v", "n").union(ends).groupBy("v").agg(F.sum("n").alias("n")), "v")
    low = at.select(F.col("v").alias("_lo"), F.col("before").alias("_from"))
    high = at.select(F.col("v").alias("_hi"), (F.col("before") + F.col("n")).alias("_till"))
    got = asked.join(low, lo == F.col("_lo")).join(high, hi == F.col("_hi"))
    return got.withColumn(name, F.col("_till") - F.col("_from")).drop("_lo", "_hi", "_from", "_till")


def class_distances(points: DataFrame, k: int) -> DataFrame:
    """(y, x, w, of_class, k_class, distance) of distinct ``points`` (y, x, w): how many rows the class y has, and how far the
    k-th nearest other row of it is, or the furthest where it has fewer. Classes of one row are left out.

    Points are numbered in the order of class and value and looked at in blocks of it, each with the last points of the block
    before and the first of the next; k points on either side hold the k nearest rows."""
    sizes = points.groupBy("y").agg(F.sum("w").alias("of_class")).where("of_class > 1")
    sizes = sizes.select(F.col("y").alias("_y"), "of_class", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    whole = points.join(sizes, (F.col("y") == F.col("_y")) & (F.pmod(F.xxhash64("x"), F.lit(PARTS)) == F.col("_part"))).drop("_y", "_part")
    placed = places(whole.withColumn("at", F.struct("y", "x")), "at", "i").drop("at")
    block, inner = F.floor(F.col("i") / BLOCK), F.pmod("i", F.lit(BLOCK))
    seen = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.when(inner < k, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))), F.when(inner >= BLOCK - k, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    spread = placed.withColumn("_s", F.explode(F.array_compact(seen))).select("*", "_s.*").drop("_s")
    around = F.collect_list(F.struct("y", "x", "w", "i")).over(Window.partitionBy("b").orderBy("i").rowsBetween(-k, k))
    near = F.transform(F.filter("_around", lambda o: o["y"] == F.col("y")), lambda o: F.struct(F.abs(o["x"] - F.col("x")).alias("d"), F.when(o["i"] == F.col("i"), o["w"] - 1).otherwise(o["w"]).alias("w")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    kth = F.aggregate(F.sort_array(near), start, lambda a, o: F.when((a["n"] >= F.col("k_class")) | (o["w"] == 0), a).otherwise(F.struct((a["n"] + o["w"]).alias("n"), o["d"].alias("d"))))
    got = spread.withColumn("_around", around).where("own").withColumn("k_class", F.least(F.lit(k), F.col("of_class") - 1))
    return got.withColumn("distance", kth["d"]).select("y", "x", "w", "of_class", "k_class", "distance")


def _of_classes(rows: DataFrame, k: int) -> float | None:
    """Information, in nats, of rows (x, y) with classes y."""
    points = rows.groupBy("y", "x").agg(F.count("*").alias("w"))
    near = class_distances(points, k).withColumn("r", _under(F.col("distance"), F.col("x"))).persist(StorageLevel.MEMORY_AND_DISK)
    values = near.groupBy(F.col("x").alias("v")).agg(F.sum("w").alias("n"))
    asked = near.groupBy("x", "r").agg(F.sum("w").alias("w"))
    each = near.agg(F.sum("w").alias("n"), F.sum(F.col("w") * (digamma(F.col("k_class")) - digamma(F.col("of_class")))).alias("s")).where("n > 0")
    one = each.join(_within(values, asked, "x", "r", "m").agg(F.sum(F.col("w") * digamma(F.col("m"))).alias("m")))
    got = one.select(digamma(F.col("n")) + (F.col("s") - F.col("m")) / F.col("n")).first()
    near.unpersist()
    return None if got is None else max(0.0, got[0])


def _of_numbers(rows: DataFrame, k: int) -> float | None:
    """Information, in nats, of rows (x, y) of numbers, each over its deviation, with distances in the greater of the two."""
    s = rows.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    if s["n"] < 2:
        return None
    k = min(k, s["n"] - 1)
    points = rows.groupBy(F.array(*(F.col(c) / (s[c] or 1.0) for c in ("x", "y"))).alias("at")).agg(F.count("*").alias("w"))
    near = nearest(points, k, 2, widest=True).groupBy("at", "w").agg(F.max("k_distance").alias("d"))
    near = near.select(F.col("at")[0].alias("x"), F.col("at")[1].alias("y"), "w", "d").withColumn("r", _under(F.col("d"), F.col("x"), F.col("y"))).persist(StorageLevel.MEMORY_AND_DISK)
    total = digamma(F.lit(s["n"])) + digamma(F.lit(k))
    for c in ("x", "y"):
        values = near.groupBy(F.col(c).alias("v")).agg(F.sum("w").alias("n"))
        counted = _within(values, near.groupBy(c, "r").agg(F.sum("w").alias("w")), c, "r", "m")
        total = total - F.lit(counted.agg(F.sum(F.col("w") * digamma(F.col("m")))).first()[0] / s["n"])
    got = rows.sparkSession.range(1).select(total).first()[0]
    near.unpersist()
    return max(0.0, got)


def nearest_information(df: DataFrame, features: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """(feature, information, importance, band): mutual information in nats of each number feature and ``target``, by the
    ``k``-th nearest rows; importance is over the most informative feature's, high over 0.7, medium over 0.3, else low.

    A target that is no number, or has fewer than 20 values, stands for classes, and its nulls for one more; of a number target
    with more values, nulls are left out. Rows with a null or NaN in a feature are left out for all of them. A class of one
    row is left out, and a feature without two rows has null information and importance 0. No noise is added: equal values
    are at distance 0, and all of them lie within any radius. The features' few numbers meet on the driver, a feature at a
    time."""
    features = list(features)
    x = [F.col(c).cast("double") for c in features]
    whole = df
    for v in x:
        whole = whole.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    numbers = target in set(numeric(df)) and whole.select(target).where(F.col(target).isNotNull()).distinct().limit(20).count() == 20
    found = []
    for c, v in zip(features, x, strict=True):
        if numbers:
            y = F.col(target).cast("double")
            found.append((c, _of_numbers(whole.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))).select((v + 0.0).alias("x"), (y + 0.0).alias("y")), k)))
        else:  # a prefix keeps the null class apart from a text
            y = F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit(""))
            found.append((c, _of_classes(whole.select((v + 0.0).alias("x"), y.alias("y")), k)))
    most = max((v for _, v in found if v is not None), default=0.0)
    share = [(v or 0.0) / most if most > 0 else 0.0 for _, v in found]
    rows = [(c, v, s, "high" if s > 0.7 else "medium" if s > 0.3 else "low") for (c, v), s in zip(found, share, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, information double, importance double, band string")
