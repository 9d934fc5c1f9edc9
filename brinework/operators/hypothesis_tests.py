"""Hypothesis tests. Statistics are aggregates; only their few numbers meet on the driver for the p-value."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinework.functions.columns import categorical, numeric
from brinework.functions.special import chi2_sf, f_sf, kolmogorov_sf, normal_sf
from brinework.operators.ranks import average_ranks, group_medians, running, sizes_of


def _row(spark, **values) -> DataFrame:
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows that have both."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, dof, p_value, cramers_v, n): independence of two columns, with Yates' correction for one degree of
    freedom. The sum over all cells, the empty ones too, comes from the cells with rows and the margins."""
    cells = contingency(df, a, b).withColumnsRenamed({a: "_a", b: "_b"})
    rows = cells.groupBy("_a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("_b").agg(F.sum("n").alias("cb"))
    one = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(rows.agg(F.count("*").alias("r"))).join(cols.agg(F.count("*").alias("c"))).first()
    n, r, c = one["n"], one["r"], one["c"]
    dof = (r - 1) * (c - 1)
    if dof < 1:
        return _row(df.sparkSession, statistic=None, dof=max(dof, 0), p_value=None, cramers_v=None, n=n)
    if dof == 1:  # four cells, some maybe empty
        full = rows.crossJoin(cols).join(cells, ["_a", "_b"], "left").select(F.coalesce("n", F.lit(0)).alias("o"), (F.col("ra") * F.col("cb") / n).alias("e"))
        gap = F.abs(F.col("o") - F.col("e"))
        stat = full.agg(F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / F.col("e"))).first()[0]
    else:
        joined = cells.join(rows, "_a").join(cols, "_b")
        stat = n * (joined.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb")))).first()[0] - 1)
    v = math.sqrt(max(stat, 0.0) / (n * min(r - 1, c - 1)))
    return _row(df.sparkSession, statistic=float(stat), dof=dof, p_value=chi2_sf(stat, dof), cramers_v=v, n=n)


def anova(df: DataFrame, value: str, by: str, least: int = 3) -> DataFrame:
    """(statistic, groups, n, p_value): one-way, over rows that have both; null where a group has under ``least``."""
    g = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("m"), F.coalesce(F.var_samp(F.col(value).cast("double")), F.lit(0.0)).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("n").alias("least"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n").cast("double")).alias("mean"), F.sum((F.col("n") - 1) * F.col("v")).alias("within")).first()
    if s["k"] < 2 or s["least"] < least or not s["within"]:
        return _row(df.sparkSession, statistic=None, groups=s["k"], n=s["n"], p_value=None)
    between = g.agg(F.sum(F.col("n") * F.pow(F.col("m") - s["mean"], F.lit(2)))).first()[0]
    d1, d2 = s["k"] - 1, s["n"] - s["k"]
    stat = (between / d1) / (s["within"] / d2)
    return _row(df.sparkSession, statistic=stat, groups=s["k"], n=s["n"], p_value=f_sf(stat, d1, d2))


def kruskal(df: DataFrame, value: str, by: str) -> DataFrame:
    """(statistic, groups, n, p_value): Kruskal-Wallis with the correction for ties."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(by).alias("g"))
    ranks = average_ranks(rows, "x")
    ties = ranks.agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("t")).first()
    sums = rows.groupBy("g", "x").agg(F.count("*").alias("m")).join(ranks.select("x", "rank"), "x").groupBy("g").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    s = sums.agg(F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q")).first()
    n = ties["n"] or 0
    fix = 1 - ties["t"] / (n**3 - n) if n > 1 else 0
    if s["k"] < 2 or fix <= 0:
        return _row(df.sparkSession, statistic=None, groups=s["k"], n=n, p_value=None)
    stat = (12 / (n * (n + 1)) * s["q"] - 3 * (n + 1)) / fix
    return _row(df.sparkSession, statistic=stat, groups=s["k"], n=n, p_value=chi2_sf(stat, s["k"] - 1))


def levene(df: DataFrame, value: str, by: str) -> DataFrame:
    """ANOVA of the distances from the group medians."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(by).alias("g"))
    return anova(rows.join(group_medians(rows, "x", "g"), "g").select("g", F.abs(F.col("x") - F.col("mid")).alias("x")), "x", "g")


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """(statistic, n, p_value): Kolmogorov-Smirnov distance from the normal law of the same mean and deviation, by the
    counts of distinct values."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    m = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("*").alias("n")).first()
    if not m["s"]:
        return _row(df.sparkSession, statistic=None, n=m["n"], p_value=None)
    steps = running(sizes_of(x, "x"), "x").withColumn("c", F.col("n").cast("double")).withColumn("till", F.col("before") + F.col("c"))
    z = (F.col("x") - m["m"]) / m["s"]
    cdf = F.lit(0.5) * (1 + _erf(z / math.sqrt(2)))
    got = steps.withColumn("cdf", cdf).agg(F.max(F.greatest(F.col("till") / m["n"] - F.col("cdf"), F.col("cdf") - (F.col("till") - F.col("c")) / m["n"]))).first()[0]
    return _row(df.sparkSession, statistic=got, n=m["n"], p_value=kolmogorov_sf(got * math.sqrt(m["n"])))


def anderson_normal(df: DataFrame, value: str) -> DataFrame:
    """(statistic, n, critical, normal): Anderson-Darling against the normal law of the same mean and deviation, at 5
    percent. Values of one size are summed at once: ranks i+1..j of a value add to both logarithms in closed form."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    m = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("*").alias("n")).first()
    n = m["n"]
    if not m["s"]:
        return _row(df.sparkSession, statistic=None, n=n, critical=None, normal=None)
    steps = running(sizes_of(x, "x"), "x").withColumn("c", F.col("n").cast("double")).withColumn("till", F.col("before") + F.col("c"))
    z = (F.col("x") - m["m"]) / m["s"]
    cdf = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 0.5 * (1 + _erf(z / math.sqrt(2)))))
    d = steps.withColumn("j", F.col("till")).withColumn("i", F.col("j") - F.col("c")).withColumn("p", cdf)
    # the sum of 2k - 1 over k = i+1..j, and of 2n + 1 - 2k
    low, high = F.col("j") * F.col("j") - F.col("i") * F.col("i"), F.lit(2 * n) * F.col("c") - (F.col("j") * F.col("j") - F.col("i") * F.col("i"))
    total = d.agg(F.sum(low * F.ln("p") + high * F.ln(1 - F.col("p")))).first()[0]
    stat = -n - total / n
    # Fixed value: Stephens' 5 percent point for an estimated mean and deviation.
    critical = 0.787 / (1 + 4 / n - 25 / n**2) if n > 3 else 0.787
    return _row(df.sparkSession, statistic=float(stat), n=n, critical=float(critical), normal=bool(stat < critical))


def _least_hashed(df: DataFrame, value: str, most: int, key: str | None) -> list[float]:
    """At most ``most`` values, in order: those of least hash of ``key`` or else of the whole row, as tests of this kind are
    for small samples. A hash of the value alone would take all rows of a few values."""
    rows = df.where(F.col(value).isNotNull())
    hashed = F.xxhash64(key) if key else F.xxhash64(*(c for c, k in df.dtypes if "map<" not in k and k != "variant"))
    return sorted(r[0] for r in rows.select(F.col(value).cast("double").alias("v"), hashed.alias("h")).orderBy("h", "v").limit(most).collect())


def shapiro_verdicts(df: DataFrame, columns: list[str], most: int = 5000) -> dict[str, bool | None]:
    """For each number column whether Shapiro-Wilk takes it for normal over 5 percent; None where it has under three values
    or does not vary. Two passes serve all columns: counts, and then about ``most`` values of each, those of rows whose hash
    lies under a share of all hashes. Rows that are equal in the columns have one hash and come as one row with a count."""
    if not columns:
        return {}
    x = [F.col(c).cast("double") for c in columns]
    n = df.agg(*(F.count(v).alias(str(i)) for i, v in enumerate(x))).first()
    hashed = F.pmod(F.xxhash64(F.lit(42), *x), F.lit(2**62))
    share = [min(1.0, (most + 6 * math.sqrt(most)) / max(n[i], 1)) for i in range(len(x))]
    kept = [F.when(v.isNotNull() & (F.col("_h") < F.lit(int(share[i] * 2**62))), F.struct(F.lit(i).alias("i"), v.alias("v"))) for i, v in enumerate(x)]
    cells = df.withColumn("_h", hashed).select("_h", F.explode(F.array_compact(F.array(*kept))).alias("c")).select("_h", "c.*")
    found: dict[int, list[float]] = {i: [] for i in range(len(x))}
    for r in cells.groupBy("i", "_h", "v").agg(F.count("*").alias("n")).orderBy("i", "_h", "v").collect():
        found[r["i"]] += [r["v"]] * min(r["n"], most - len(found[r["i"]]))
    out: dict[str, bool | None] = {}
    for i, c in enumerate(columns):
        v = sorted(found[i])
        out[c] = _shapiro(v)[1] > 0.05 if len(v) >= 3 and v[0] < v[-1] else None
    return out


def _shapiro(x: list[float]) -> tuple[float, float]:
    """W and its p-value for ordered values, by Royston's 1995 approximation."""
    n, normal = len(x), statistics.NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    poly = lambda c, t: sum(k * t**i for i, k in enumerate(c))
    # Royston's polynomials.
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = poly((m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n <= 5:
            f = math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a = [-last, *(v / f for v in m[1:-1]), last]
        else:
            second = poly((m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            f = math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a = [-last, -second, *(v / f for v in m[2:-2]), second, last]
    mean = math.fsum(x) / n
    w = min(1.0, math.fsum(p * q for p, q in zip(a, x, strict=True)) ** 2 / math.fsum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y, mu, sigma = -math.log(gamma - math.log(1 - w)), poly((0.5440, -0.39978, 0.025054, -0.0006714), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        y, k = math.log(1 - w), math.log(n)
        mu, sigma = poly((-1.5861, -0.31082, -0.083751, 0.0038915), k), math.exp(poly((-0.4803, -0.082676, 0.0030302), k))
    return w, normal_sf((y - mu) / sigma)


def shapiro_wilk(df: DataFrame, value: str, most: int = 5000, key: str | None = None) -> DataFrame:
    """(statistic, n, p_value, normal): Shapiro-Wilk on at most ``most`` rows of least hash; normal over 5 percent."""
    x = _least_hashed(df, value, most, key)
    if len(x) < 3 or x[0] == x[-1]:
        return _row(df.sparkSession, statistic=None, n=len(x), p_value=None, normal=None)
    w, p = _shapiro(x)
    return _row(df.sparkSession, statistic=w, n=len(x), p_value=p, normal=p > 0.05)


def normality(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(column, shapiro, kolmogorov, anderson, votes, consensus) of each number column: whether each test takes it for
    normal, and normal where two of them do. Null for a column that does not vary."""
    rows = []
    for c in columns or numeric(df):
        shapiro, ks, anderson = shapiro_wilk(df, c, key=key).first()["normal"], ks_normal(df, c).first()["p_value"], anderson_normal(df, c).first()["normal"]
        if shapiro is None or ks is None:
            rows.append((c, None, None, None, None, None))
            continue
        votes = int(shapiro) + int(ks > 0.05) + int(anderson)
        rows.append((c, bool(shapiro), bool(ks > 0.05), bool(anderson), votes, "normal" if votes >= 2 else "non_normal"))
    return df.sparkSession.createDataFrame(rows, "column string, shapiro boolean, kolmogorov boolean, anderson boolean, votes int, consensus string")


def chi_square_all(df: DataFrame, columns: list[str] | None = None, ahead: int = 3) -> DataFrame:
    """(a, b, statistic, dof, p_value, cramers_v, n): each string column with the next ``ahead``; those with fewer than
    four cells are left out."""
    columns = columns or categorical(df)
    out = df.sparkSession.createDataFrame([], "a string, b string, statistic double, dof long, p_value double, cramers_v double, n long")
    for i, a in enumerate(columns):
        for b in columns[i + 1 : i + 1 + ahead]:
            one = chi_square(df, a, b)
            out = out.union(one.where("dof >= 1").select(F.lit(a), F.lit(b), "statistic", "dof", "p_value", "cramers_v", "n"))
    return out


def group_tests(df: DataFrame, values: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """(test, value, by, statistic, groups, n, p_value) of the first five number columns by the first three string
    columns: anova and kruskal, and levene by the first two."""
    out = df.sparkSession.createDataFrame([], "test string, value string, by string, statistic double, groups long, n long, p_value double")
    for v in (values or numeric(df))[:5]:
        for i, g in enumerate((groups or categorical(df))[:3]):
            for name, test in (("anova", anova), ("kruskal", kruskal), *([("levene", levene)] if i < 2 else [])):
                out = out.union(test(df, v, g).select(F.lit(name), F.lit(v), F.lit(g), F.col("statistic").cast("double"), "groups", "n", F.col("p_value").cast("double")))
    return out


def shapiro_francia(df: DataFrame, value: str, most: int = 5000, key: str | None = None) -> DataFrame:
    """(statistic, n, p_value): Shapiro-Francia normality by Royston's 1993 approximation, on at most ``most`` rows of
    least hash."""
    x = _least_hashed(df, value, most, key)
    n = len(x)
    if n < 5 or x[0] == x[-1]:
        return _row(df.sparkSession, statistic=None, n=n, p_value=None)
    normal = statistics.NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mean = sum(x) / n
    w = sum(a * b for a, b in zip(m, x, strict=True)) ** 2 / (sum(a * a for a in m) * sum((b - mean) ** 2 for b in x))
    u = math.log(n)
    v = math.log(u)
    mu, sigma = -1.2725 + 1.0521 * (v - u), 1.0308 - 0.26758 * (v + 2 / u)
    return _row(df.sparkSession, statistic=w, n=n, p_value=normal_sf((math.log(1 - w) - mu) / sigma))


def _erf(x):
    """The error function by the expansion of Abramowitz and Stegun 7.1.26; absolute error under 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """(statistic, n, p_value): normality from skewness and kurtosis, in one pass."""
    s = df.agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k")).first()
    if s["s"] is None or s["k"] is None:
        return _row(df.sparkSession, statistic=None, n=s["n"], p_value=None)
    stat = s["n"] / 6 * (s["s"] ** 2 + s["k"] ** 2 / 4)
    return _row(df.sparkSession, statistic=stat, n=s["n"], p_value=chi2_sf(stat, 2))


def two_sided(z: float) -> float:
    return 2 * normal_sf(abs(z))
