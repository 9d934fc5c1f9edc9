"""Queries of neighbourhoods, shapes of charts, predictions and column-oriented files, with DuckDB SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from brinework.operators import charts, information, neighbours, predict
from brinework.plans.registry import query
from brinework.sources import files


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""
WITH p AS (SELECT c_custkey AS i, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
d AS (SELECT a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.i <> b.i),
k AS (SELECT i, d AS k FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d) = 10),
n AS (SELECT d.* FROM d JOIN k ON d.i = k.i WHERE d <= k),
l AS (SELECT n.i, 1 / (avg(greatest(d, k)) + 1e-10) AS density FROM n JOIN k ON n.j = k.i GROUP BY n.i),
f AS (SELECT n.i, avg(o.density) / any_value(l.density) AS lof FROM n JOIN l o ON n.j = o.i JOIN l ON n.i = l.i GROUP BY n.i)
SELECT i AS c_custkey, round(lof, 5) AS lof, lof > 1.5 AS is_outlier FROM f
""")
def local_outliers(spark, d):
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return neighbours.local_outlier_factor(c, ["x", "y"], k=10).select("c_custkey", F.round("lof", 5).alias("lof"), (F.col("lof") > 1.5).alias("is_outlier"))


@query("""
WITH e AS (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem),
p AS (SELECT *, (l_quantity - lx) / (hx - lx) * 20 AS a, (l_extendedprice - ly) / (hy - ly) * 11 AS b FROM lineitem, e),
h AS (SELECT *, (a - floor(a + 0.5)) * (a - floor(a + 0.5)) + 3 * (b - floor(b + 0.5)) * (b - floor(b + 0.5))
  < (a - (floor(a) + 0.5)) * (a - (floor(a) + 0.5)) + 3 * (b - (floor(b) + 0.5)) * (b - (floor(b) + 0.5)) AS one FROM p),
c AS (SELECT *, CASE WHEN one THEN floor(a + 0.5) ELSE floor(a) + 0.5 END AS ca, CASE WHEN one THEN floor(b + 0.5) ELSE floor(b) + 0.5 END AS cb FROM h)
SELECT round(lx + ca * (hx - lx) / 20, 6) AS x, round(ly + cb * (hy - ly) / 11, 6) AS y, count(*) AS n, round(avg(l_discount), 6) AS mean
FROM c GROUP BY ca, cb, lx, hx, ly, hy
""")
def hexagon_counts(spark, d):
    got = charts.hexagons(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", value="l_discount")
    return got.select(*(F.round(c, 6).alias(c) for c in ("x", "y")), "n", F.round("mean", 6).alias("mean"))


_SHARES = ", ".join(f"({i}, {NormalDist().inv_cdf((i + 0.5) / 100)!r})" for i in range(100))


@query(f"""
SELECT i, round(mean + sd * z, 5) AS expected, round(value, 5) AS value FROM (VALUES {_SHARES}) AS z(i, z),
  (SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, quantile_cont(o_totalprice, [(i + 0.5) / 100 FOR i IN range(100)]) AS q FROM orders),
  LATERAL (SELECT q[i + 1] AS value)
""")
def normal_quantile_points(spark, d):
    got = charts.normal_quantiles(t(spark, d, "orders"), "o_totalprice")
    return got.select("i", F.round("expected", 5).alias("expected"), F.round("value", 5).alias("value"))


@query("""
WITH s AS (SELECT event_type AS target, lag(event_type) OVER w AS source, row_number() OVER w AS i FROM events WHERE user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT CAST(least(i - 1, 5) AS INT) AS level, source, target, count(*) AS n FROM s WHERE i > 1 GROUP BY ALL
""")
def event_flows(spark, d):
    return charts.flows(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderkey % 3 = 0 AS third FROM orders
""")
def json_column_orders(spark, d):
    """All orders as texts of the form {column: {row: value}}, some 500 orders each, read back as one table."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), (F.col("o_orderkey") % 3 == 0).alias("third"))
    rows = o.groupBy(F.floor(F.col("o_orderkey") / 2000).alias("file")).agg(F.collect_list(F.struct(*o.columns)).alias("r"))
    column = lambda c: F.map_from_entries(F.transform("r", lambda x: F.struct(x["o_orderkey"].cast("string"), x[c]))).alias(c)
    texts = rows.select("file", F.to_json(F.struct(*map(column, o.columns))).alias("text"))
    return files.json_columns(texts)


_LINE = """
WITH train AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem WHERE l_orderkey % 5 <> 0),
s AS (SELECT slope, intercept, l_extendedprice AS y, intercept + slope * l_quantity AS p FROM lineitem, train WHERE l_orderkey % 5 = 0)
SELECT round(any_value(slope), 5) AS slope, round(any_value(intercept), 4) AS intercept, count(*) AS n, round(avg(abs(y - p)), 4) AS mae,
  round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM s
"""


@query(_LINE)
def price_prediction(spark, d):
    x = t(spark, d, "lineitem")
    line = predict.fit(x.where("l_orderkey % 5 <> 0"), "l_extendedprice", ["l_quantity"])
    got = predict.measures(line.predict(x.where("l_orderkey % 5 = 0")), "l_extendedprice")
    own = {"slope": F.round(F.lit(line.known["l_quantity"]), 5), "intercept": F.round(F.lit(line.known[""]), 4)}
    return got.withColumns({**own, "r2": F.round("r2", 6), **{c: F.round(c, 4) for c in ("mae", "rmse")}})


@query("""
WITH t AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem WHERE l_orderkey % 5 <> 0),
m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM t),
c AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb, my, ma, mb FROM m),
s AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS na, coalesce(lead(l_discount) OVER w, first_value(l_discount) OVER w) AS nb
  FROM lineitem WHERE l_orderkey % 5 = 0 WINDOW w AS (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice)),
e AS (SELECT s.*, c.*, y - (my + ca * (a - ma) + cb * (b - mb)) AS e0, y - (my + ca * (na - ma) + cb * (b - mb)) AS ea, y - (my + ca * (a - ma) + cb * (nb - mb)) AS eb FROM s, c),
r AS (SELECT avg(ea * ea) - avg(e0 * e0) AS a, avg(eb * eb) - avg(e0 * e0) AS b FROM e),
u AS (SELECT 'l_quantity' AS feature, a AS v, greatest(a, 0) / (greatest(a, 0) + greatest(b, 0)) AS share FROM r UNION ALL SELECT 'l_discount', b, greatest(b, 0) / (greatest(a, 0) + greatest(b, 0)) FROM r)
SELECT feature, round(v, 1) AS importance, round(share, 5) AS share, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INT) AS rank FROM u
""")
def price_importance(spark, d):
    x = t(spark, d, "lineitem")
    line = predict.fit(x.where("l_orderkey % 5 <> 0"), "l_extendedprice", ["l_quantity", "l_discount"])
    got = predict.permutation_importance(line, x.where("l_orderkey % 5 = 0"), block=F.col("l_orderkey") % 64, order=[F.col("l_orderkey"), F.col("l_linenumber")])
    return got.select("feature", F.round("importance", 1).alias("importance"), F.round("share", 5).alias("share"), "rank")


_SLACK = "8e-15"
_PSI = "psi AS (SELECT i AS n, -0.5772156649015329 + sum(CASE WHEN i > 1 THEN 1.0 / (i - 1) ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM customer))) AS i) WHERE i >= 1)"
_BANDS = "SELECT feature, round(v, 6) AS information, round(v / max(v) OVER (), 6) AS importance, CASE WHEN v / max(v) OVER () > 0.7 THEN 'high' WHEN v / max(v) OVER () > 0.3 THEN 'medium' ELSE 'low' END AS band"


@query(f"""
WITH c AS (SELECT c_custkey AS i, c_acctbal AS bal, CAST(c_nationkey AS DOUBLE) AS nation, CASE WHEN c_acctbal + c_custkey % 7 * 500 > 5000 THEN 'up' WHEN c_custkey % 3 = 0 THEN 'down' END AS y FROM customer),
r AS (SELECT 'bal' AS feature, i, bal AS x, coalesce('=' || y, '') AS y FROM c UNION ALL SELECT 'nation', i, nation, coalesce('=' || y, '') FROM c),
k AS (SELECT a.feature, a.i, any_value(a.x) AS x, list_sort(list(abs(a.x - b.x)))[3] AS d, count(*) + 1 AS n FROM r a JOIN r b ON a.feature = b.feature AND a.y = b.y AND a.i <> b.i GROUP BY ALL),
m AS (SELECT k.feature, k.i, any_value(k.n) AS n, count(*) AS m FROM k JOIN r b ON k.feature = b.feature AND abs(b.x - k.x) <= greatest(0, d - (d + abs(k.x)) * {_SLACK}) GROUP BY ALL),
{_PSI}, s AS (SELECT feature, greatest(0, any_value(t.v) + avg(p3.v - pn.v - pm.v)) AS v FROM m JOIN psi pn ON pn.n = m.n JOIN psi pm ON pm.n = m.m JOIN psi p3 ON p3.n = 3 JOIN psi t ON t.n = (SELECT count(*) FROM customer) GROUP BY 1)
{_BANDS} FROM s""")
def class_information(spark, d):
    """What number columns tell about classes, null being one."""
    y = "CASE WHEN c_acctbal + c_custkey % 7 * 500 > 5000 THEN 'up' WHEN c_custkey % 3 = 0 THEN 'down' END AS y"
    c = t(spark, d, "customer").selectExpr("c_acctbal AS bal", "CAST(c_nationkey AS DOUBLE) AS nation", y)
    return information.nearest_information(c, ["bal", "nation"], "y").withColumns({x: F.round(x, 6) for x in ("information", "importance")})


@query(f"""
WITH c AS (SELECT c_custkey AS i, c_acctbal + c_custkey % 5 * 1000 AS y, c_acctbal AS bal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer),
q AS (SELECT 'bal' AS feature, i, bal AS x, y FROM c UNION ALL SELECT 'nation', i, nation, y FROM c),
r AS (SELECT feature, i, x / stddev_pop(x) OVER (PARTITION BY feature) AS x, y / stddev_pop(y) OVER (PARTITION BY feature) AS y FROM q),
k AS (SELECT a.feature, a.i, any_value(a.x) AS x, any_value(a.y) AS y, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] AS d FROM r a JOIN r b ON a.feature = b.feature AND a.i <> b.i GROUP BY ALL),
u AS (SELECT *, greatest(0, d - (d + abs(x) + abs(y)) * {_SLACK}) AS e FROM k),
m AS (SELECT u.feature, u.i, count(*) FILTER (abs(b.x - u.x) <= e) AS mx, count(*) FILTER (abs(b.y - u.y) <= e) AS my FROM u JOIN r b ON u.feature = b.feature GROUP BY ALL),
{_PSI}, s AS (SELECT feature, greatest(0, any_value(t.v) + any_value(p3.v) - avg(px.v + py.v)) AS v FROM m JOIN psi px ON px.n = m.mx JOIN psi py ON py.n = m.my JOIN psi p3 ON p3.n = 3 JOIN psi t ON t.n = (SELECT count(*) FROM customer) GROUP BY 1)
{_BANDS} FROM s""")
def number_information(spark, d):
    """What number columns tell about a number."""
    c = t(spark, d, "customer").selectExpr("c_acctbal AS bal", "CAST(c_nationkey AS DOUBLE) AS nation", "c_acctbal + c_custkey % 5 * 1000 AS y")
    return information.nearest_information(c, ["bal", "nation"], "y").withColumns({x: F.round(x, 6) for x in ("information", "importance")})
