"""Profiling, quality, test and model queries over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.functions.columns import long_form
from brinework.operators import anomaly, cleaning, impute, models, profile, quality, hypothesis_tests, timeseries
from brinework.operators import insights as rules
from brinework.plans.registry import ORACLE, query

#: Line items with injected nulls, the same in both engines.
LI = "(SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty, l_extendedprice AS price, l_discount AS disc, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status FROM lineitem)"
NUM = ["qty", "price", "disc", "tax"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {LI}" for c in NUM)


def li(spark, d, x=None):
    x = spark.read.parquet(f"{d}/lineitem.parquet") if x is None else x
    keep = lambda c, k, m: F.when(F.col(k) % m != 0, F.col(c))
    return x.select(keep("l_quantity", "l_orderkey", 7).alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), keep("l_tax", "l_partkey", 11).alias("tax"), keep("l_returnflag", "l_orderkey", 5).alias("flag"), F.col("l_linestatus").alias("status"))


def rounded(df, n=6):
    return df.withColumns({f.name: F.round(f.name, n) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


_ALL = "qty, price, disc, tax, flag, status"
_OVER = f"""
SELECT rows, 6 AS columns, rows * 6 AS cells, missing_cells, round(missing_cells * 100.0 / (rows * 6), 6) AS missing_percent, 3 AS columns_with_missing, 0 AS columns_all_missing,
  rows - unique_rows AS duplicate_rows, unique_rows, round((rows * 6 - missing_cells) * 100.0 / (rows * 6), 6) AS density_percent, round(missing_cells * 100.0 / (rows * 6), 6) AS sparsity_percent,
  round((rows - unique_rows) * 100.0 / rows, 6) AS duplicate_percent, 4 AS numeric_columns, 2 AS categorical_columns, 0 AS date_columns, 'qty,price,disc,tax,flag,status' AS column_names, round(25 / 6.0, 6) AS mean_name_length
FROM (SELECT count(*) AS rows, CAST(sum((qty IS NULL)::INT + (tax IS NULL)::INT + (flag IS NULL)::INT) AS BIGINT) AS missing_cells FROM {LI}),
  (SELECT count(*) AS unique_rows FROM (SELECT DISTINCT {_ALL} FROM {LI}))"""


@query(_OVER)
def overview(spark, d):
    return rounded(profile.overview(li(spark, d)))


_Q = ", ".join(f"round(quantile_cont(v, {q}), 6) AS p{round(q * 100)}" for q in profile.QUANTILES)


@query(f"""
WITH c AS ({LONG}), n AS (SELECT col, v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT col, arg_min(v, (-n, v)) AS mode FROM n GROUP BY col),
s AS (SELECT col, count(v) AS count, count(*) - count(v) AS missing, round(avg(v), 5) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_samp(v) * 100 / avg(v), 3) AS cv_percent, round(var_samp(v), 4) AS variance, min(v) AS min, max(v) AS max, {_Q},
  count(DISTINCT v) AS "distinct", count(*) FILTER (v = 0) AS zeros FROM c GROUP BY col),
f AS (SELECT col, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM c GROUP BY col),
o AS (SELECT c.col, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers FROM c JOIN f ON f.col = c.col GROUP BY c.col),
e AS (SELECT col, array_to_string(list(CAST(v AS DECIMAL(18,2)) ORDER BY v)[1:3], ',') AS least, array_to_string(list(CAST(v AS DECIMAL(18,2)) ORDER BY v DESC)[1:3], ',') AS largest FROM c WHERE v IS NOT NULL GROUP BY col)
SELECT s.col AS "column", s.* EXCLUDE (col), mode, outliers, least, largest, round((b - a), 6) AS iqr, round(max - min, 6) AS range, round(a - 1.5 * (b - a), 6) AS low_fence, round(b + 1.5 * (b - a), 6) AS high_fence,
  round(missing * 100.0 / (count + missing), 6) AS missing_percent, round(zeros * 100.0 / (count + missing), 6) AS zeros_percent
FROM s JOIN m ON m.col = s.col JOIN o ON o.col = s.col JOIN f ON f.col = s.col JOIN e ON e.col = s.col""")
def numeric_stats(spark, d):
    s = profile.numeric_stats(li(spark, d), NUM).drop("skewness", "kurtosis", "skew_label", "kurtosis_label")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("decimal(18,2)").cast("string")), ",")
    return rounded(s.withColumns({"variance": F.round("variance", 4), "mean": F.round("mean", 5), "cv_percent": F.round("cv_percent", 3), "least": text("least"), "largest": text("largest")}))


@query(f"""
WITH c AS ({LONG}), m AS (SELECT col, avg(v) AS m FROM c GROUP BY col),
k AS (SELECT c.col, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM c JOIN m ON m.col = c.col GROUP BY c.col),
l AS (SELECT col, m3 / m2 ** 1.5 AS s, m4 / m2 ** 2 - 3 AS k FROM k)
SELECT col AS "column", round(s, 5) AS skewness, round(k, 5) AS kurtosis, CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN s > 0.5 THEN 'right' ELSE 'left' END AS skew_label,
  CASE WHEN abs(k) < 0.5 THEN 'mesokurtic' WHEN k > 0.5 THEN 'leptokurtic' ELSE 'platykurtic' END AS kurtosis_label FROM l""")
def shape_stats(spark, d):
    return rounded(profile.numeric_stats(li(spark, d), NUM).select("column", "skewness", "kurtosis", "skew_label", "kurtosis_label"), 5)


@query(f"""
WITH c AS (SELECT 'flag' AS col, flag AS v FROM {LI} UNION ALL SELECT 'status', status FROM {LI}), n AS (SELECT col, v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL),
t AS (SELECT col, CAST(sum(n) AS BIGINT) AS count, count(*) AS d, max(n) AS top_count, min(n) AS least, arg_min(v, (-n, v)) AS top FROM n GROUP BY col),
r AS (SELECT n.*, row_number() OVER (PARTITION BY col ORDER BY n, v) AS i FROM n),
g AS (SELECT r.col, 2.0 * sum(i * n) / (any_value(d) * any_value(count)) - (any_value(d) + 1.0) / any_value(d) AS gini, -sum(n / count * log2(n / count + 1e-10)) AS entropy FROM r JOIN t ON t.col = r.col GROUP BY r.col)
SELECT t.col AS "column", count, (SELECT count(*) FROM lineitem) - count AS missing, d AS "distinct", top, top_count, round(top_count * 100.0 / count, 6) AS top_percent, round(entropy, 6) AS entropy,
  round(gini, 6) AS gini, round(top_count / least, 6) AS imbalance_ratio, 100.0::DOUBLE AS top5_percent, 100.0::DOUBLE AS top10_percent, round(log2(d), 6) AS max_entropy, round(CASE WHEN d > 1 THEN entropy / log2(d) ELSE 0 END, 6) AS normalized_entropy,
  d > 50 AS high_cardinality, top_count / count > 0.9 AS imbalanced, CASE WHEN d <= 1 THEN 'constant' WHEN d / count < 0.01 THEN 'low' WHEN d / count < 0.1 THEN 'medium' WHEN d / count < 0.5 THEN 'high' ELSE 'very_high' END AS cardinality,
  (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM n WHERE n.col = t.col) AS top_values FROM t JOIN g ON g.col = t.col""")
def categorical_stats(spark, d):
    return rounded(profile.categorical_stats(li(spark, d)).withColumn("top_values", F.array_join("top_values", ",")))


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {LI}" for a, b in _PAIRS))
def pearson_pairs(spark, d):
    return rounded(profile.pearson(li(spark, d), NUM))


_RANKED = "SELECT (rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0) AS x, (rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0) AS y FROM {li} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS r FROM ({_RANKED.format(a=a, b=b, li=LI)})" for a, b in _PAIRS))
def spearman_pairs(spark, d):
    return rounded(profile.spearman(li(spark, d), NUM))


@query(f"""
WITH c AS (SELECT qty AS x, disc AS y, count(*) AS w FROM {LI} WHERE qty IS NOT NULL AND disc IS NOT NULL GROUP BY ALL),
s AS (SELECT sum(sign(b.y - a.y) * a.w * b.w) AS s FROM c a JOIN c b ON a.x < b.x), n AS (SELECT sum(w) AS n FROM c),
tx AS (SELECT sum(w * (w - 1) / 2) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY x)), ty AS (SELECT sum(w * (w - 1) / 2) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY y))
SELECT 'qty' AS a, 'disc' AS b, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau FROM s, n, tx, ty""")
def kendall_pair(spark, d):
    return rounded(profile.kendall(li(spark, d), ["qty", "disc"]))


@query(f"""
WITH c AS (SELECT * FROM ({LONG}) WHERE v IS NOT NULL), f AS (SELECT col, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, count(*) AS n FROM c GROUP BY col HAVING count(*) >= 10),
o AS (SELECT c.col, any_value(n) AS n, any_value(a - 1.5 * (b - a)) AS low, any_value(b + 1.5 * (b - a)) AS high, count(*) FILTER (v < a - 3 * (b - a) OR v > b + 3 * (b - a)) AS extreme,
  count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS odd FROM c JOIN f ON f.col = c.col GROUP BY c.col)
SELECT col AS "column", n, round(low, 6) AS low, round(high, 6) AS high, odd - extreme AS mild, extreme, odd AS total, round(odd * 100.0 / n, 6) AS percent, 'low' AS severity_of_fraction,
  CASE WHEN odd * 100.0 / n < 1 THEN 'low' WHEN odd * 100.0 / n < 5 THEN 'moderate' WHEN odd * 100.0 / n < 10 THEN 'high' ELSE 'very_high' END AS severity FROM o""")
def iqr_outliers(spark, d):
    return rounded(profile.iqr_outliers(li(spark, d), NUM))


@query("""
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT 'l_extendedprice' AS "column", l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem, f WHERE l_extendedprice > b + 1.5 * (b - a) OR l_extendedprice < a - 1.5 * (b - a) ORDER BY l_orderkey, l_linenumber LIMIT 50""")
def outlier_rows(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return profile.outlier_rows(x, ["l_orderkey", "l_linenumber"], ["l_extendedprice"])


@query(f"""
WITH c AS (SELECT * FROM ({LONG}) WHERE v IS NOT NULL), f AS (SELECT col, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM c GROUP BY col HAVING count(*) >= 10),
o AS (SELECT c.col, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS odd FROM c JOIN f ON f.col = c.col GROUP BY c.col)
SELECT CAST(sum(odd) AS BIGINT) AS total, count(*) FILTER (odd > 0) AS columns_with_outliers, count(*) AS columns_analyzed FROM o""")
def outlier_summary(spark, d):
    return profile.outlier_summary(profile.iqr_outliers(li(spark, d), NUM))


_ODD = f"""
c AS (SELECT * FROM ({LONG}) WHERE v IS NOT NULL), f AS (SELECT col, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev_samp(v) AS s FROM c GROUP BY col HAVING count(*) >= 10),
o AS (SELECT c.col, count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS iqr_outliers, count(*) FILTER (abs((v - m) / s) > 3) AS zscore_outliers, count(*) AS n FROM c JOIN f ON f.col = c.col GROUP BY c.col)"""


@query(f"WITH {_ODD} SELECT col AS \"column\", iqr_outliers, zscore_outliers, CASE WHEN abs(iqr_outliers - zscore_outliers) < 10 THEN 'high' ELSE 'low' END AS agreement FROM o")
def outlier_consensus(spark, d):
    return anomaly.detect(li(spark, d), "all", NUM)


@query(f"""
WITH c AS (SELECT * FROM ({LONG}) WHERE v IS NOT NULL), m AS (SELECT col, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM c GROUP BY col), z AS (SELECT c.col, n, (v - m) / s AS z FROM c JOIN m ON m.col = c.col)
SELECT col AS "column", n, count(*) FILTER (abs(z) > 1.5) AS total, count(*) FILTER (abs(z) > 2 AND abs(z) <= 3) AS in_2_3, count(*) FILTER (abs(z) > 3 AND abs(z) <= 4) AS in_3_4, count(*) FILTER (abs(z) > 4) AS over_4,
  round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, CASE WHEN max(abs(z)) > 5 THEN 'Extreme outliers detected - investigate data quality issues' WHEN max(abs(z)) > 4 THEN 'Significant outliers - consider removal or transformation'
  WHEN max(abs(z)) > 3 THEN 'Moderate outliers - analyze context before action' ELSE 'Outliers within normal range' END AS advice FROM z GROUP BY col, n""")
def zscore_outliers(spark, d):
    return rounded(profile.zscore_outliers(li(spark, d), NUM, 1.5))


_LOST = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0 / count(*) AS p, {c in NUM} AS num FROM {LI}" for c in [*NUM, "flag", "status"])


@query(f"""SELECT col AS "column", missing, round(p, 6) AS percent, CASE WHEN p = 0 THEN 'none' WHEN p > 50 THEN 'high' WHEN p > 10 THEN 'moderate' ELSE 'low' END AS band,
  CASE WHEN p = 0 THEN NULL WHEN p < 5 THEN 'MCAR_likely' WHEN p < 30 THEN 'MAR_possible' ELSE 'MNAR_possible' END AS kind,
  CASE WHEN p = 0 THEN NULL WHEN NOT num THEN 'mode_or_ml_based' WHEN p < 5 THEN 'mean_or_median' ELSE 'ml_based_imputation' END AS advice FROM ({_LOST})""")
def missing_patterns(spark, d):
    return rounded(profile.missing_patterns(li(spark, d)))


_FLAGS = [(a, b) for i, a in enumerate(["qty", "tax", "flag"]) for b in ["qty", "tax", "flag"][i + 1 :]]


@query("SELECT a, b, round(r, 6) AS r, CAST(n AS BIGINT) AS n, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) AS r, count(*) AS n FROM {LI}" for a, b in _FLAGS) + ") WHERE abs(r) > 0.001")
def missing_correlation(spark, d):
    return rounded(profile.missing_correlation(li(spark, d), 0.001))


# columns whose most common value has all, over 95 percent, over 90 percent and fewer of the rows that have one
_TOP = {"one": "CASE WHEN l_orderkey % 3 = 0 THEN 'x' END", "most": "CASE WHEN l_partkey % 40 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'x' END", "many": "CASE WHEN l_partkey % 14 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'x' END", "some": "l_returnflag", "none": "CAST(NULL AS VARCHAR)"}


@query("SELECT * FROM (SELECT \"column\", count(*) AS \"distinct\", round(max(n) / sum(n), 6) AS top_share, CASE WHEN count(*) = 1 THEN 'constant' WHEN max(n) / sum(n) > 0.95 THEN 'quasi-constant' WHEN max(n) / sum(n) > 0.9 THEN 'low-variance' END AS kind FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS v, count(*) AS n FROM lineitem GROUP BY ALL" for c, e in _TOP.items()) + ") WHERE v IS NOT NULL GROUP BY 1) WHERE kind IS NOT NULL")
def constant_features(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(profile.constant_features(x.selectExpr(*(f"{e.replace('VARCHAR', 'STRING')} AS {c}" for c, e in _TOP.items()))))


@query("""
SELECT c AS "column", kind AS type, nulls, round(nulls * 100.0 / n, 6) AS null_percent, dist AS "distinct", round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(med, 6) AS median, round(sd, 4) AS std, tops AS top_values FROM (
  SELECT 'o_totalprice' AS c, 'double' AS kind, count(*) - count(o_totalprice) AS nulls, count(*) AS n, count(DISTINCT o_totalprice) AS dist, min(o_totalprice) AS mn, max(o_totalprice) AS mx, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS med, stddev_samp(o_totalprice) AS sd, NULL AS tops FROM orders
  UNION ALL SELECT 'o_orderstatus', 'string', count(*) - count(o_orderstatus), count(*), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL, NULL, (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1)) FROM orders)""")
def column_profile(spark, d):
    return rounded(profile.column_profile(spark.read.parquet(f"{d}/orders.parquet").select("o_totalprice", "o_orderstatus")).withColumn("std", F.round("std", 4)))


_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {LI}" for a, b in _PAIRS)


# columns made of one another, so that pairs are on both sides of the threshold
_MADE = "(SELECT l_quantity AS qty, l_discount AS disc, l_quantity * (1 - l_discount) AS net, -2 * l_quantity + l_linenumber AS less, l_quantity * 3 AS thrice FROM lineitem)"
_MADE_NAMES = ["qty", "disc", "net", "less", "thrice"]
_MADE_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {_MADE}" for i, a in enumerate(_MADE_NAMES) for b in _MADE_NAMES[i + 1 :])


@query(f"""SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.9 THEN 'very_strong' WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' WHEN abs(r) > 0.3 THEN 'weak' ELSE 'very_weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, abs(r) > 0.99 AS perfect FROM ({_MADE_PAIRS}) WHERE abs(r) > 0.3""")
def strong_pairs(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    made = x.selectExpr("l_quantity AS qty", "l_discount AS disc", "l_quantity * (1 - l_discount) AS net", "-2 * l_quantity + l_linenumber AS less", "l_quantity * 3 AS thrice")
    return rounded(profile.strong_pairs(profile.pearson(made, _MADE_NAMES).drop("n")))


_DISTRICT = "(SELECT ps.q AS q, ps.p AS p, ps.q * 2 AS twice FROM (SELECT l_quantity AS q, l_linenumber AS p FROM lineitem) ps)"


def _ranked_sql(a, b):
    return f"(SELECT corr(rank_a, rank_b) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rank_a, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rank_b FROM {_DISTRICT}))"


def _tau_sql(a, b):
    cells = f"(SELECT {a} AS x, {b} AS y, count(*) AS w FROM {_DISTRICT} GROUP BY ALL)"
    tied = lambda c: f"(SELECT sum(w * (w - 1) / 2) FROM (SELECT sum(w) AS w FROM {cells} GROUP BY {c}))"
    n = f"(SELECT sum(w) * (sum(w) - 1) / 2 FROM {cells})"
    return f"(SELECT sum(sign(v.y - u.y) * u.w * v.w) / sqrt(({n} - {tied('x')}) * ({n} - {tied('y')})) FROM {cells} u JOIN {cells} v ON u.x < v.x)"


_THREE = [("q", "p"), ("q", "twice"), ("p", "twice")]
_ALL_R = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr({a}, {b}) FROM {_DISTRICT}) AS pearson, {_ranked_sql(a, b)} AS spearman, {_tau_sql(a, b)} AS kendall" for a, b in _THREE)


@query(f"""SELECT a, b, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall, round(pearson, 6) AS r, CASE len(list_distinct([sign(pearson), sign(spearman), sign(kendall)])) WHEN 1 THEN 'all_agree' WHEN 2 THEN 'partial_agreement' ELSE 'conflicting' END AS agreement,
  CASE WHEN abs(pearson) > 0.9 THEN 'very_strong' WHEN abs(pearson) > 0.7 THEN 'strong' WHEN abs(pearson) > 0.5 THEN 'moderate' WHEN abs(pearson) > 0.3 THEN 'weak' ELSE 'very_weak' END AS strength, CASE WHEN pearson > 0 THEN 'positive' ELSE 'negative' END AS direction, abs(pearson) > 0.99 AS perfect FROM ({_ALL_R})""")
def correlation_agreement(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("p"), (F.col("l_quantity") * 2).alias("twice"))
    return rounded(profile.strong_pairs(profile.correlations(x), -1.0))


@query()
def kendall_pairs(spark, d):
    """All pairs, a continuous column among them; DuckDB has no way to them that is not quadratic."""
    return rounded(profile.kendall(li(spark, d), NUM))


@query(f"SELECT count(*) FILTER (abs(r) >= 0.001) AS n FROM ({_PAIR_SQL})")
def pairs_above(spark, d):
    return profile.pairs_above(profile.pearson(li(spark, d), NUM), 0.001)


_SHAPE = f"""WITH c AS ({LONG}), m AS (SELECT col, avg(v) AS m FROM c GROUP BY col),
k AS (SELECT c.col, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM c JOIN m ON m.col = c.col GROUP BY c.col),
l AS (SELECT col, m3 / m2 ** 1.5 AS s, m4 / m2 ** 2 - 3 AS k FROM k),
d AS (SELECT col AS "column", CASE WHEN abs(s) < 0.5 AND abs(k) < 0.5 THEN 'normal' WHEN s > 1 THEN 'right_skewed' WHEN s < -1 THEN 'left_skewed' WHEN k > 3 THEN 'heavy_tailed' WHEN k < -1 THEN 'light_tailed' WHEN abs(s) < 0.5 THEN 'symmetric_non_normal' ELSE 'unknown' END AS distribution FROM l)"""


@query(f"{_SHAPE} SELECT * FROM d")
def distribution_type(spark, d):
    return profile.distribution_type(profile.numeric_stats(li(spark, d), NUM))


@query(f"{_SHAPE} SELECT count(*) FILTER (distribution = 'normal') AS normal_columns, count(*) FILTER (distribution = 'right_skewed') AS right_skewed, count(*) FILTER (distribution = 'left_skewed') AS left_skewed, count(*) FILTER (distribution = 'heavy_tailed') AS heavy_tailed FROM d")
def distribution_counts(spark, d):
    return profile.distribution_counts(profile.distribution_type(profile.numeric_stats(li(spark, d), NUM)))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM d)
SELECT min(day) AS first, max(day) AS last, max(day) - min(day) AS days, count(*) AS distinct_days, max(day) - min(day) + 1 - count(*) AS missing_days, quantile_cont(gap, 0.5) AS median_gap_days, CASE WHEN quantile_cont(gap, 0.5) <= 1 THEN 'daily' WHEN quantile_cont(gap, 0.5) <= 7 THEN 'weekly' WHEN quantile_cont(gap, 0.5) <= 31 THEN 'monthly' ELSE 'irregular' END AS frequency FROM g""")
def date_stats(spark, d):
    return profile.date_stats(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate")


@query(f"SELECT round(greatest(0, least(100, 100 * (1 - 0.7 * missing_cells / cells - 0.3 * duplicate_rows / rows))), 6) AS score, rows, missing_cells, duplicate_rows FROM ({_OVER})")
def quality_catalog(spark, d):
    return rounded(quality.catalog_score(li(spark, d)))


_ODD_PERCENT = f"(WITH {_ODD} SELECT avg(iqr_outliers * 100.0 / n) FROM o)"
_EDA = f"""
SELECT 100 - missing_percent AS completeness, 100 - duplicate_percent AS uniqueness, 100 - least(100, {_ODD_PERCENT}) AS validity, 50.0::DOUBLE AS consistency, 100.0::DOUBLE AS accuracy, 100.0::DOUBLE AS timeliness FROM ({_OVER})"""
_EDA_SCORE = "completeness * 0.25 + uniqueness * 0.20 + validity * 0.25 + consistency * 0.15 + accuracy * 0.10 + timeliness * 0.05"
_EDA_DIMS = ["completeness", "uniqueness", "validity", "consistency", "accuracy", "timeliness"]
_LOWEST = "list_sort([" + ", ".join(f"{{'v': {k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(_EDA_DIMS)) + "])[1:3]"


@query(f"""SELECT {", ".join(f"round({k}, 6) AS {k}" for k in _EDA_DIMS)}, round({_EDA_SCORE}, 6) AS score, CASE WHEN {_EDA_SCORE} >= 90 THEN 'Excellent' WHEN {_EDA_SCORE} >= 75 THEN 'Good' WHEN {_EDA_SCORE} >= 60 THEN 'Fair' WHEN {_EDA_SCORE} >= 40 THEN 'Poor' ELSE 'Very Poor' END AS grade,
  array_to_string(list_transform(list_filter({_LOWEST}, lambda x: x.v < 85), lambda x: x.k), ',') AS priorities FROM ({_EDA})""")
def quality_eda(spark, d):
    return rounded(quality.eda_score(li(spark, d)))


@query("""WITH o AS (SELECT count(*) AS n, count(*) FILTER (p_retailprice - 905 < 0) AS low FROM part)
SELECT CAST(100 - (CASE WHEN low > 0 THEN 2 ELSE 1 END) * 100.0 / 3 AS DOUBLE) AS accuracy FROM o""")
def quality_eda_accuracy(spark, d):
    """The quirks of accuracy: a price under 0, and a name with "age" in it."""
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_retailprice") - 905).alias("price"), F.col("p_size").alias("average_size"), F.col("p_partkey").alias("other"))
    return quality.eda_score(p).select("accuracy")


_CLEANING = f"""SELECT 100 - missing_percent AS completeness, (SELECT count(DISTINCT qty) + count(DISTINCT price) + count(DISTINCT disc) + count(DISTINCT tax) + count(DISTINCT flag) + count(DISTINCT status) FROM {LI}) * 100.0 / (rows * 6) AS uniqueness,
  100 - duplicate_rows * 100.0 / rows AS consistency, 100.0::DOUBLE AS validity, 100.0::DOUBLE AS accuracy, 100.0::DOUBLE AS timeliness, duplicate_rows, 0 AS infinite_values FROM ({_OVER})"""
_CLEANING_SCORE = "completeness * 0.30 + uniqueness * 0.20 + consistency * 0.20 + validity * 0.10 + accuracy * 0.10 + timeliness * 0.10"
_LETTER = "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 85 THEN 'B+' WHEN score >= 80 THEN 'B' WHEN score >= 75 THEN 'C+' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
_CLEANED = f"(SELECT *, {_LETTER} AS letter FROM (SELECT *, {_CLEANING_SCORE} AS score FROM ({_CLEANING})))"


@query(f"SELECT * REPLACE ({', '.join(f'round({k}, 6) AS {k}' for k in ('completeness', 'uniqueness', 'consistency', 'score'))}) FROM {_CLEANED}")
def quality_cleaning(spark, d):
    return rounded(quality.cleaning_score(li(spark, d)))


_ALERTS = {"score": 85, "completeness": 95, "uniqueness": 80, "consistency": 90, "validity": 95, "accuracy": 90, "timeliness": 90}


@query("SELECT dimension, round(value, 6) AS value, threshold, CASE WHEN threshold - value >= 20 THEN 'critical' WHEN threshold - value >= 10 THEN 'high' WHEN threshold - value >= 5 THEN 'medium' ELSE 'low' END AS severity FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, {t}.0::DOUBLE AS threshold FROM {_CLEANED}" for k, t in _ALERTS.items()) + ") WHERE value < threshold")
def quality_alerts(spark, d):
    return rounded(quality.alerts(quality.cleaning_score(li(spark, d))))


_STATE = " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, CASE WHEN {k} >= {t} THEN 'pass' WHEN {k} >= {t - 10} THEN 'warning' ELSE 'fail' END AS status, {advice} AS advice FROM {_CLEANED}" for k, t, advice in (
    ("completeness", 95, "CASE WHEN completeness < 95 THEN (CASE WHEN 100 - completeness > 10 THEN 'high' ELSE 'medium' END) || printf(': address %.1f%% missing data', 100 - completeness) END"),
    ("uniqueness", 80, "CASE WHEN uniqueness < 80 THEN 'medium: review columns with low uniqueness' END"),
    ("consistency", 90, "CASE WHEN consistency < 90 AND duplicate_rows > 0 THEN 'high: remove or investigate ' || duplicate_rows || ' duplicate rows' END"),
    ("validity", 95, "NULL"), ("accuracy", 90, "NULL"), ("timeliness", 90, "NULL"),
))


@query(f"""SELECT dimension, round(value, 6) AS value, status, advice FROM (
SELECT 'score' AS dimension, score AS value, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'acceptable' WHEN score >= 60 THEN 'needs_improvement' ELSE 'poor' END AS status, CASE WHEN score < 70 THEN 'critical: re-run cleaning with more aggressive parameters' END AS advice FROM {_CLEANED}
UNION ALL {_STATE} UNION ALL SELECT 'rows_lost_percent', count(*) FILTER (l_linenumber = 1) * 100.0 / count(*), 'info', NULL FROM lineitem AS every)""".replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber <> 1)"))
def quality_report(spark, d):
    """A table that lost the first line of every order."""
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(quality.cleaning_report(x, li(spark, d, x.where("l_linenumber <> 1"))))


@query(f"SELECT rows AS rows_before, unique_rows AS rows_after, u.completeness, 100.0::DOUBLE AS uniqueness, 85.0::DOUBLE AS fixed_score, 'B' AS fixed_grade FROM ({_OVER}), (SELECT round(100 - sum((qty IS NULL)::INT + (tax IS NULL)::INT + (flag IS NULL)::INT) * 100.0 / (count(*) * 6), 6) AS completeness FROM (SELECT DISTINCT * FROM {LI})) u")
def quality_live(spark, d):
    return rounded(quality.live_result(li(spark, d), cleaning.drop_duplicates(li(spark, d))).drop("score", "letter"))


_CHART = f"""SELECT 100 - missing_percent AS completeness, 100 - duplicate_percent AS uniqueness, 100.0::DOUBLE AS validity, greatest(0, 100 - 2 * (WITH {_ODD} SELECT sum(iqr_outliers) * 100.0 / (SELECT count(*) * 4 FROM lineitem) FROM o)) AS consistency FROM ({_OVER})"""
_CHART_SCORE = "0.40 * completeness + 0.25 * uniqueness + 0.25 * validity + 0.10 * consistency"


@query(f"SELECT round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, validity, round(consistency, 6) AS consistency, round({_CHART_SCORE}, 6) AS score FROM ({_CHART})")
def quality_chart(spark, d):
    return rounded(quality.chart_score(li(spark, d)))


@query(f"SELECT rows, columns, numeric_columns, categorical_columns, date_columns, missing_percent AS null_percent, duplicate_percent, (SELECT round({_CHART_SCORE}, 6) FROM ({_CHART})) AS quality_score FROM ({_OVER})")
def dashboard_stats(spark, d):
    return rounded(quality.dashboard_stats(li(spark, d)))


@query(f"SELECT rows, round(missing_cells / cells, 6) AS missing_ratio, round(duplicate_rows / rows, 6) AS duplicate_ratio, missing_cells / cells <= 0.5 AND duplicate_rows / rows <= 0.3 AS healthy FROM ({_OVER})")
def quality_health(spark, d):
    return rounded(quality.health(li(spark, d)))


_SCORED = f"(SELECT *, greatest(0, least(100, 100 * (1 - 0.7 * missing_cells / cells - 0.3 * duplicate_rows / rows))) AS score FROM ({_OVER}))"


@query(f"""SELECT * FROM (
SELECT 1 AS rank, 'issue' AS kind, 'duplicates' AS name, CASE WHEN duplicate_percent > 5 THEN 'high' ELSE 'medium' END AS severity, NULL::VARCHAR AS strategy, NULL::VARCHAR AS preset FROM {_SCORED} WHERE duplicate_rows > 0
UNION ALL SELECT 2, 'recommendation', 'remove_duplicates', NULL, NULL, 'standard' FROM {_SCORED} WHERE duplicate_rows > 0
UNION ALL SELECT 3, 'issue', 'missing_values', CASE WHEN missing_percent > 10 THEN 'high' ELSE 'medium' END, NULL, NULL FROM {_SCORED} WHERE missing_cells > 0
UNION ALL SELECT 4, 'recommendation', 'handle_missing', NULL, CASE WHEN missing_percent > 15 THEN 'knn' WHEN missing_percent > 5 THEN 'median' ELSE 'drop' END, CASE WHEN missing_percent > 15 THEN 'aggressive' WHEN missing_percent > 5 THEN 'standard' ELSE 'minimal' END FROM {_SCORED} WHERE missing_cells > 0
UNION ALL SELECT 5, 'recommendation', CASE WHEN score < 70 THEN 'comprehensive_cleaning' ELSE 'ml_preparation' END, NULL, NULL, CASE WHEN score < 70 THEN 'production' ELSE 'ml_ready' END FROM {_SCORED})""")
def quality_suggestions(spark, d):
    return quality.suggestions(li(spark, d))


_PAIR_COUNTS = f"(SELECT count(*) FILTER (abs(r) > 0.3) AS strong, count(*) FILTER (abs(r) > 0.99) AS perfect FROM ({_PAIR_SQL}))"
_ODD_NAMES = lambda t: f"(WITH {_ODD} SELECT coalesce(list(col ORDER BY col) FILTER (iqr_outliers * 100.0 / n > {t}), []) FROM o)"
# columns that are not normal, told by skewness and kurtosis here: uniform ones, which any test rejects
_ODD_SHAPES = "(SELECT count(*) AS odd FROM (" + " UNION ALL ".join(f"SELECT count({c}) / 6.0 * (skewness({c}) ** 2 + kurtosis({c}) ** 2 / 4) AS jb FROM {LI}" for c in NUM) + ") WHERE jb > 5.99)"
# columns that others explain: the variance inflation of each, by the normal equations of the others
_FACTS = f"(SELECT o.*, p.*, {_EDA_SCORE} AS score, {_ODD_NAMES(5)} AS odd5, {_ODD_NAMES(10)} AS odd10 FROM ({_OVER}) o, {_PAIR_COUNTS} p, ({_EDA}) e)"


@query(f"""SELECT rank, kind, text FROM (
SELECT 1 AS rank, CASE WHEN rows > 1000000 THEN 'large' WHEN rows < 100 THEN 'small' ELSE 'size' END AS kind, CASE WHEN rows > 1000000 THEN 'large dataset of ' || rows || ' rows: consider sampling' WHEN rows < 100 THEN 'small dataset of ' || rows || ' rows: tests may lack power' ELSE rows || ' rows and 6 columns suit a full analysis' END AS text FROM {_FACTS}
UNION ALL SELECT 2, CASE WHEN missing_percent > 20 THEN 'missing_high' WHEN missing_percent > 5 THEN 'missing_moderate' ELSE 'missing_low' END, printf('%.1f%% missing', missing_percent) || CASE WHEN missing_percent > 20 THEN ': investigate patterns, impute or remove rows' WHEN missing_percent > 5 THEN ': impute' ELSE ': little impact' END FROM {_FACTS} WHERE missing_percent > 0
UNION ALL SELECT 3, 'duplicates', printf('%d duplicate rows, %.1f%%: remove them', duplicate_rows, duplicate_percent) FROM {_FACTS} WHERE duplicate_percent > 5
UNION ALL SELECT 4, 'strong_pairs', strong || ' strong correlations' FROM {_FACTS} WHERE strong > 0
UNION ALL SELECT 4, 'perfect_pairs', perfect || ' perfect correlations: maybe the same feature twice' FROM {_FACTS} WHERE perfect > 0
UNION ALL SELECT 6, 'outliers', 'many outliers in ' || len(odd10) || ' columns: ' || array_to_string(odd10[1:3], ', ') FROM {_FACTS} WHERE len(odd10) > 0
UNION ALL SELECT 7, 'non_normal', odd || ' of 4 number columns are not normal: consider transformations' FROM {_ODD_SHAPES} WHERE odd > 4 * 0.7
UNION ALL SELECT 8, CASE WHEN score >= 90 THEN 'quality_excellent' WHEN score >= 75 THEN 'quality_good' WHEN score >= 60 THEN 'quality_fair' ELSE 'quality_poor' END,
  CASE WHEN score >= 90 THEN printf('excellent quality, %.1f', score) WHEN score >= 75 THEN printf('good quality, %.1f', score) WHEN score >= 60 THEN printf('fair quality, %.1f: clean before modeling', score) ELSE printf('poor quality, %.1f: thorough cleaning needed', score) END FROM {_FACTS})""")
def rule_insights(spark, d):
    return rules.insights(li(spark, d))


@query(f"""SELECT rank, kind, text FROM (
SELECT 1 AS rank, 'missing' AS kind, 'high priority: fill or drop missing values' AS text FROM {_FACTS} WHERE missing_percent > 10
UNION ALL SELECT 1, 'duplicates', 'high priority: remove ' || duplicate_rows || ' duplicate rows' FROM {_FACTS} WHERE duplicate_percent > 1
UNION ALL SELECT 3, 'outliers', 'medium priority: investigate outliers in ' || len(odd5) || ' columns: ' || array_to_string(odd5[1:2], ', ') FROM {_FACTS} WHERE len(odd5) > 0
UNION ALL SELECT 4, 'selection', 'low priority: components or feature selection' FROM {_FACTS} WHERE strong > 5
UNION ALL SELECT 5, CASE WHEN score >= 90 THEN 'ready' WHEN score >= 75 THEN 'nearly_ready' ELSE 'cleaning_required' END, CASE WHEN score >= 90 THEN 'ready for modeling' WHEN score >= 75 THEN 'nearly ready: clean a little, cross-validate' ELSE 'improve quality before modeling' END FROM {_FACTS}
UNION ALL SELECT 6, 'checklist', 'missing values, duplicates, encoding, scaling, train and test split')""")
def rule_recommendations(spark, d):
    return rules.recommendations(li(spark, d))


@query(f"SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM ({_PAIR_SQL}) WHERE abs(r) >= 0.7")
def context_pairs(spark, d):
    return rounded(rules.context_pairs(profile.pearson(li(spark, d), NUM)))


@query(f"{_SHAPE}, {_ODD.strip().replace('c AS', 'c2 AS', 1).replace('FROM c GROUP', 'FROM c2 GROUP').replace('FROM c JOIN', 'FROM c2 c JOIN')} SELECT d.*, round(iqr_outliers * 100.0 / n, 6) AS outlier_percent, distribution IN ('right_skewed', 'left_skewed', 'heavy_tailed') AS skewed, iqr_outliers * 100.0 / n > 5 AS odd FROM d JOIN o ON o.col = d.\"column\" WHERE distribution IN ('right_skewed', 'left_skewed', 'heavy_tailed') OR iqr_outliers * 100.0 / n > 5")
def interesting_columns(spark, d):
    return rounded(rules.interesting_columns(li(spark, d), NUM))


@query("""
WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM o GROUP BY a), c AS (SELECT b, sum(n) AS c FROM o GROUP BY b), t AS (SELECT sum(n) AS t FROM o)
SELECT round(sum((coalesce(n, 0) - r * c / t) ** 2 / (r * c / t)), 6) AS statistic, (count(DISTINCT r.a) - 1) * (count(DISTINCT c.b) - 1) AS dof, CAST(any_value(t) AS BIGINT) AS n,
  round(sqrt(statistic_ / (any_value(t) * least(count(DISTINCT r.a) - 1, count(DISTINCT c.b) - 1))), 6) AS cramers_v, round(exp(-statistic_ / 2) * (1 + statistic_ / 2 + statistic_ ** 2 / 8 + statistic_ ** 3 / 48), 6) AS p_value
FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b""".replace("statistic_", "sum((coalesce(n, 0) - r * c / t) ** 2 / (r * c / t))"))  # 8 degrees of freedom: a tail in closed form
def chi_square(spark, d):
    return rounded(hypothesis_tests.chi_square(spark.read.parquet(f"{d}/orders.parquet"), "o_orderstatus", "o_orderpriority"))


_ANOVA = """WITH g AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM ({rows}) GROUP BY g), t AS (SELECT sum(n * m) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM g) SELECT round(f, 5) AS statistic, k AS groups, CAST(n AS BIGINT) AS n, round(pow(x, a) * (1 + a * (1 - x)), 6) AS p_value
FROM (SELECT *, (n - k) / 2.0 AS a, (n - k) / (n - k + 4 * f) AS x FROM (SELECT (sum(g.n * (m - mean) ** 2) / (any_value(k) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - any_value(k))) AS f, any_value(k) AS k, any_value(t.n) AS n FROM g, t))"""  # five groups: the tail of F with 4 and n - 5 degrees
_OP = "SELECT o_totalprice AS x, o_orderpriority AS g FROM orders"


@query(_ANOVA.format(rows=_OP))
def anova(spark, d):
    return rounded(hypothesis_tests.anova(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", "o_orderpriority").withColumn("p_value", F.round("p_value", 6)).withColumn("statistic", F.round("statistic", 5)))


@query(_ANOVA.format(rows=f"SELECT abs(x - m) AS x, r.g AS g FROM ({_OP}) r JOIN (SELECT g, quantile_cont(x, 0.5) AS m FROM ({_OP}) GROUP BY g) q ON q.g = r.g"))
def levene(spark, d):
    return rounded(hypothesis_tests.levene(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", "o_orderpriority").withColumn("p_value", F.round("p_value", 6)).withColumn("statistic", F.round("statistic", 5)))


@query("""
WITH r AS (SELECT l_quantity AS x, l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem),
t AS (SELECT 1 - sum(n ** 3 - n) / (sum(n) ** 3 - sum(n)) AS fix, sum(n) AS n FROM (SELECT count(*) AS n FROM r GROUP BY x)), s AS (SELECT g, sum(r) AS s, count(*) AS m FROM r GROUP BY g)
SELECT round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / any_value(fix), 4) AS statistic, count(*) AS groups, CAST(any_value(n) AS BIGINT) AS n,
  round(exp(-(12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / any_value(fix) / 2), 6) AS p_value FROM s, t""")  # three groups: 2 degrees of freedom
def kruskal(spark, d):
    return rounded(hypothesis_tests.kruskal(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_returnflag").withColumn("statistic", F.round("statistic", 4)))


_T = "(1 / (1 + 0.3275911 * abs(u)))"
_ERF = f"sign(u) * (1 - {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-u * u))"
_NORMAL = f"""WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders),
g AS (SELECT o_totalprice AS x, count(*) AS c FROM orders GROUP BY 1), u AS (SELECT *, (x - m) / s / sqrt(2.0) AS u, sum(c) OVER (ORDER BY x) AS j FROM g, m), p AS (SELECT *, 0.5 * (1 + {_ERF}) AS p FROM u)"""


@query(f"{_NORMAL} SELECT round(max(greatest(j / n - p, p - (j - c) / n)), 7) AS statistic, any_value(n) AS n, round(list_sum(list_transform(range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * any_value(n) * max(greatest(j / n - p, p - (j - c) / n)) ** 2))), 6) AS p_value FROM p")
def ks_normal(spark, d):
    return rounded(hypothesis_tests.ks_normal(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice").withColumn("p_value", F.round("p_value", 6)), 7)


@query("""
WITH m AS (SELECT count(*) AS n, avg(o_totalprice) AS m FROM orders), k AS (SELECT any_value(n) AS n, avg((o_totalprice - m) ** 2) AS m2, avg((o_totalprice - m) ** 3) AS m3, avg((o_totalprice - m) ** 4) AS m4 FROM orders, m)
SELECT round(n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) AS statistic, n, round(exp(-n / 12 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)), 6) AS p_value FROM k""")
def jarque_bera(spark, d):
    return rounded(hypothesis_tests.jarque_bera(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice").withColumn("statistic", F.round("statistic", 4)))


@query()
def vif(spark, d):
    return models.vif(li(spark, d), NUM)


@query(f"""
WITH s AS (SELECT sum(qty * disc) / sqrt(sum(qty * qty) * sum(disc * disc)) AS a, sum(qty * net) / sqrt(sum(qty * qty) * sum(net * net)) AS b, sum(disc * net) / sqrt(sum(disc * disc) * sum(net * net)) AS c FROM {_MADE}),
v AS (SELECT unnest(['qty', 'disc', 'net']) AS "column", unnest([1 - c * c, 1 - b * b, 1 - a * a]) / (1 + 2 * a * b * c - a * a - b * b - c * c) AS vif FROM s)
SELECT "column", round(vif, 4) AS vif, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS severity FROM v""")
def vif_of_three(spark, d):
    """Three columns have their inflation in closed form."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_quantity AS qty", "l_discount AS disc", "l_quantity * (1 - l_discount) AS net")
    return rounded(models.vif(x, ["qty", "disc", "net"]), 4)


@query()
def pca(spark, d):
    return models.pca(li(spark, d), NUM).select("component", "variance", "ratio", "cumulative")


@query()
def kmeans(spark, d):
    return models.kmeans(li(spark, d), NUM)


_BINNED = lambda c: f"CAST(least(floor(({c} - {c}_lo) / ({c}_hi - {c}_lo) * 10), 9) AS VARCHAR)"


@query(f"""
WITH e AS (SELECT min(qty) AS qty_lo, max(qty) AS qty_hi, min(price) AS price_lo, max(price) AS price_hi FROM {LI}),
c AS (SELECT 'qty' AS feature, {_BINNED('qty')} AS x, flag AS y FROM {LI}, e UNION ALL SELECT 'price', {_BINNED('price')}, flag FROM {LI}, e UNION ALL SELECT 'status', status, flag FROM {LI}),
n AS (SELECT feature, x, y, count(*) AS n FROM c WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM n),
i AS (SELECT feature, greatest(0, sum(n / t * ln(n * t / (nx * ny)))) AS v FROM j GROUP BY 1), m AS (SELECT *, coalesce(v / nullif(max(v) OVER (), 0), 0) AS r FROM i)
SELECT feature, round(v, 6) AS information, round(r, 6) AS importance, CASE WHEN r > 0.7 THEN 'high' WHEN r > 0.3 THEN 'medium' ELSE 'low' END AS band FROM m""")
def mutual_information(spark, d):
    return rounded(models.mutual_information(li(spark, d), ["qty", "price", "status"], "flag"))


@query("""
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS b, var_samp(c_acctbal) AS va, var_samp(c_nationkey) AS vb, covar_samp(c_acctbal, c_nationkey) AS c FROM customer)
SELECT c_custkey, round(sqrt((vb * (c_acctbal - a) ** 2 - 2 * c * (c_acctbal - a) * (c_nationkey - b) + va * (c_nationkey - b) ** 2) / (va * vb - c * c)), 5) AS distance FROM customer, m""")
def mahalanobis(spark, d):
    return rounded(models.mahalanobis(spark.read.parquet(f"{d}/customer.parquet"), ["c_acctbal", "c_nationkey"], ["c_custkey"]), 5)


@query()
def pca_summary(spark, d):
    return models.pca_summary(models.pca(li(spark, d), NUM))


@query()
def pca_top_features(spark, d):
    return models.pca_top_features(models.pca(li(spark, d), NUM))


@query()
def anomaly_totals(spark, d):
    return anomaly.detect(li(spark, d), "isolation_forest", ["price", "disc"])


@query()
def series_strengths(spark, d):
    return timeseries.strengths(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice")


@query()
def series_analysis(spark, d):
    return timeseries.analysis(spark.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_totalprice"), "o_orderdate")


@query("""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1), l AS (SELECT regr_slope(v, date_diff('day', DATE '1970-01-01', day)) AS b, regr_intercept(v, date_diff('day', DATE '1970-01-01', day)) AS a, max(day) AS last FROM s)
SELECT last + i::INT AS day, round(a + b * date_diff('day', DATE '1970-01-01', last + i::INT), 3) AS forecast FROM l, range(1, 8) r(i)""")
def series_forecast(spark, d):
    return rounded(timeseries.forecast(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice"), 3)


_DAILY = "(SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1)"


@query(f"SELECT round(arg_min(value, day), 6) AS first, round(arg_max(value, day), 6) AS last, CASE WHEN arg_max(value, day) > arg_min(value, day) THEN 'increasing' WHEN arg_max(value, day) < arg_min(value, day) THEN 'decreasing' ELSE 'stable' END AS trend FROM {_DAILY}")
def series_trend(spark, d):
    return rounded(timeseries.trend(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice"))


@query(f"SELECT a.day, round(any_value(a.value), 6) AS value, round(CASE WHEN count(b.value) = 7 THEN sum(b.value) / 7 END, 6) AS average FROM {_DAILY} a JOIN {_DAILY} b ON b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY a.day")
def moving_average(spark, d):
    return rounded(timeseries.moving_average(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice", 7))


@query(f"""
WITH x AS (SELECT row_number() OVER (ORDER BY day) AS i, value - avg(value) OVER () AS v FROM {_DAILY}), n AS (SELECT count(*) AS n, sum(v * v) AS s FROM x)
SELECT CAST(k AS INTEGER) AS lag, round(sum(a.v * b.v) / any_value(s), 6) AS acf, k > 0 AND abs(sum(a.v * b.v) / any_value(s)) > 2 / sqrt(any_value(n)) AS significant
FROM (SELECT unnest(range(0, 21)) AS k) JOIN n ON k <= n.n // 2 JOIN x a ON true JOIN x b ON b.i = a.i + k GROUP BY k""")
def series_acf(spark, d):
    got = timeseries.correlations(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice")
    return rounded(got.select("lag", "acf", "significant"))


@query()
def series_correlations(spark, d):
    return timeseries.correlations(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice")


@query(f"""
WITH m AS (SELECT a.day, any_value(a.value) AS value, CASE WHEN count(b.value) = 7 THEN sum(b.value) / 7 END AS trend, datediff('day', DATE '1970-01-01', a.day) % 7 AS p
  FROM {_DAILY} a JOIN {_DAILY} b ON b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY a.day),
s AS (SELECT p, avg(value - trend) - avg(avg(value - trend)) OVER () AS seasonal FROM m WHERE trend IS NOT NULL GROUP BY p)
SELECT day, round(value, 5) AS value, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(value - trend - seasonal, 5) AS residual FROM m LEFT JOIN s ON s.p = m.p""")
def seasonal_parts(spark, d):
    return rounded(timeseries.decompose(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice"), 5)


@query()
def adf_test(spark, d):
    return timeseries.adf(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_totalprice")


@query(LONG.replace("AS col", 'AS "column"', 1).replace("AS v", "AS value", 1))
def cells(spark, d):
    return long_form(li(spark, d), NUM)


@query()
def shapiro_wilk(spark, d):
    return hypothesis_tests.shapiro_wilk(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", key="o_orderkey")


@query()
def normality(spark, d):
    return hypothesis_tests.normality(li(spark, d), NUM)


@query(f"SELECT 'o_orderstatus' AS a, 'o_orderpriority' AS b, * FROM ({ORACLE['chi_square']})")
def chi_square_all(spark, d):
    return rounded(hypothesis_tests.chi_square_all(spark.read.parquet(f"{d}/orders.parquet")))


_KINDS = "SELECT o_totalprice AS x, 'o_orderstatus' AS kind, o_orderstatus AS g FROM orders UNION ALL SELECT o_totalprice, 'o_orderpriority', o_orderpriority FROM orders"
_FAR = f"SELECT abs(x - m) AS x, r.kind AS kind, r.g AS g FROM ({_KINDS}) r JOIN (SELECT kind, g, quantile_cont(x, 0.5) AS m FROM ({_KINDS}) GROUP BY ALL) q ON q.kind = r.kind AND q.g = r.g"


def _variances(name: str, rows: str) -> str:
    """SQL of one-way tests; three or five groups have their tails in closed form."""
    return f"""SELECT '{name}' AS test, kind, f AS statistic, k AS "groups", n, CASE k WHEN 3 THEN pow(x, a) WHEN 5 THEN pow(x, a) * (1 + a * (1 - x)) END AS p_value FROM (
SELECT *, (n - k) / 2.0 AS a, (n - k) / (n - k + (k - 1) * f) AS x FROM (
SELECT kind, sum(n) AS n, count(*) AS k, (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM (
SELECT kind, g, count(*) AS n, avg(x) - (SELECT avg(o_totalprice) FROM orders) AS m, var_samp(x) AS v FROM ({rows}) GROUP BY ALL) GROUP BY kind))"""


_RANKED = f"""WITH r AS (SELECT kind, g, x, rank() OVER (PARTITION BY kind ORDER BY x) + (count(*) OVER (PARTITION BY kind, x) - 1) / 2.0 AS r FROM ({_KINDS})),
t AS (SELECT kind, 1 - sum(n ** 3 - n) / (sum(n) ** 3 - sum(n)) AS fix, sum(n) AS n FROM (SELECT kind, count(*) AS n FROM r GROUP BY kind, x) GROUP BY kind),
s AS (SELECT kind, g, sum(r) AS s, count(*) AS m FROM r GROUP BY ALL),
h AS (SELECT t.kind AS kind, any_value(n) AS n, count(*) AS k, (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / any_value(fix) AS h FROM s JOIN t ON t.kind = s.kind GROUP BY ALL)
SELECT 'kruskal' AS test, kind, h AS statistic, k AS "groups", n, CASE k WHEN 3 THEN exp(-h / 2) WHEN 5 THEN exp(-h / 2) * (1 + h / 2) END AS p_value FROM h"""




@query(f"SELECT test, 'o_totalprice' AS value, kind AS \"by\", round(statistic, 5) AS statistic, \"groups\", CAST(n AS BIGINT) AS n, round(p_value, 6) AS p_value FROM ({_variances('anova', _KINDS)} UNION ALL {_variances('levene', _FAR)} UNION ALL ({_RANKED}))")
def group_tests(spark, d):
    got = hypothesis_tests.group_tests(spark.read.parquet(f"{d}/orders.parquet"), ["o_totalprice"])
    return got.withColumn("statistic", F.round("statistic", 5)).withColumn("p_value", F.round("p_value", 6))


@query(f"""{_NORMAL}, a AS (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS q, j - c AS i FROM p)
SELECT round(-any_value(n) - sum((j * j - i * i) * ln(q) + (2 * n * c - (j * j - i * i)) * ln(1 - q)) / any_value(n), 4) AS statistic, any_value(n) AS n, round(0.787 / (1 + 4 / any_value(n) - 25 / any_value(n) ** 2), 7) AS critical,
  -any_value(n) - sum((j * j - i * i) * ln(q) + (2 * n * c - (j * j - i * i)) * ln(1 - q)) / any_value(n) < 0.787 / (1 + 4 / any_value(n) - 25 / any_value(n) ** 2) AS normal FROM a""")
def anderson_normal(spark, d):
    return rounded(hypothesis_tests.anderson_normal(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice").withColumn("statistic", F.round("statistic", 4)), 7)


@query()
def shapiro_francia(spark, d):
    return hypothesis_tests.shapiro_francia(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", key="o_orderkey")


@query()
def isolation_forest(spark, d):
    found = anomaly.flags(li(spark, d), ["price", "disc"])
    return anomaly.summary(found, ["price", "disc"])


@query()
def knn_impute(spark, d):
    return impute.knn(li(spark, d).select("qty", "price", "tax"), ["qty", "price", "tax"]).agg(F.count("qty").alias("n"), F.avg("qty").alias("qty"))


@query()
def mice_impute(spark, d):
    return impute.mice(li(spark, d).select("qty", "price", "tax"), ["qty", "price", "tax"]).agg(F.count("qty").alias("n"), F.avg("qty").alias("qty"))
