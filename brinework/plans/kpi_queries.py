"""KPI queries over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinework.operators import kpi
from brinework.plans.registry import query
from brinework.sources.star import star_of

ORDERS = "(SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_totalprice AS total_amount, c_mktsegment AS channel FROM orders JOIN customer ON c_custkey = o_custkey) AS o"
CUSTOMERS = "(SELECT c_custkey AS customer_id, min(o_orderdate) + to_days(CAST(c_custkey % 90 - 30 AS INTEGER)) AS acquisition_date, any_value(c_mktsegment) AS channel FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c"
MARKETING = "(SELECT c_mktsegment AS channel, CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM customer GROUP BY 1) AS m"
CAC = f"SELECT m.channel, coalesce(spend / nullif(n, 0), 0) AS cac FROM {MARKETING} LEFT JOIN (SELECT channel, count(*) AS n FROM {CUSTOMERS} GROUP BY 1) w ON w.channel = m.channel"
LTV = f"SELECT CAST(date_trunc('month', acquisition_date) AS DATE) AS cohort, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o.customer_id) AS customers FROM {ORDERS} JOIN {CUSTOMERS} ON o.customer_id = c.customer_id GROUP BY 1"
SOLD = "(SELECT l_partkey AS product_id, sum(l_quantity) AS quantity, any_value(p_retailprice) AS price, any_value(p_retailprice) * 0.6 AS cost, any_value(p_type) AS category FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) AS s"


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


for _period, _unit in kpi.PERIODS.items():
    query(
        f"SELECT CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1", name=f"revenue_{_period}"
    )(lambda spark, d, p=_period: kpi.revenue(star_of(spark, d), p))
    query(
        f"SELECT CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS period, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS aov FROM orders GROUP BY 1", name=f"orders_aov_{_period}"
    )(lambda spark, d, p=_period: kpi.orders_and_aov(star_of(spark, d), p))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders WHERE o_orderdate >= '1996-02-10' AND o_orderdate <= '1997-06-15' GROUP BY 1")
def revenue_range(spark, d):
    return kpi.revenue(star_of(spark, d), "monthly", "1996-02-10", "1997-06-15")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS aov FROM orders GROUP BY 1")
def aov_monthly(spark, d):
    return kpi.aov(star_of(spark, d), "monthly")


@query("SELECT count(*) AS new_customers, CAST(0 AS BIGINT) AS returning_customers, count(*) FILTER (n > 1) AS repeat_customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def new_vs_returning(spark, d):
    return kpi.new_vs_returning(star_of(spark, d))


@query(f"SELECT product_id, round(quantity * price, 4) AS revenue, category FROM {SOLD} ORDER BY 2 DESC, 1 LIMIT 10")
def top_products(spark, d):
    return kpi.top_products(star_of(spark, d, lines=True)).withColumn("revenue", F.round("revenue", 4))


@query(f"SELECT channel, round(cac, 6) AS cac FROM ({CAC})")
def cac_by_channel(spark, d):
    return r6(kpi.cac(star_of(spark, d)), "cac")


@query(f"SELECT channel, round(cac, 6) AS cpa FROM ({CAC})")
def cost_per_acquisition(spark, d):
    return r6(kpi.cost_per_acquisition(star_of(spark, d)), "cpa")


@query(f"SELECT CAST(date_trunc('month', acquisition_date) AS DATE) AS cohort, count(DISTINCT customer_id) AS customers FROM {CUSTOMERS} GROUP BY 1")
def customer_cohorts(spark, d):
    return kpi.cohorts(star_of(spark, d))


@query("SELECT user_id AS customer_id, arg_min(event_type, (ts, event_id)) AS channel FROM events GROUP BY 1")
def first_touch(spark, d):
    return kpi.attribution(star_of(spark, d), "first_touch")


@query("SELECT user_id AS customer_id, arg_max(event_type, (ts, event_id)) AS channel FROM events GROUP BY 1")
def last_touch(spark, d):
    return kpi.attribution(star_of(spark, d), "last_touch")


@query("SELECT DISTINCT user_id AS customer_id, event_type AS channel FROM events")
def multi_touch(spark, d):
    return kpi.attribution(star_of(spark, d), "multi_touch")


@query(f"SELECT g.channel, revenue, spend AS spend_amount, round(CASE WHEN spend > 0 THEN revenue / spend END, 6) AS roas FROM (SELECT channel, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM {ORDERS} GROUP BY 1) g LEFT JOIN {MARKETING} ON m.channel = g.channel")
def roas_by_channel(spark, d):
    return r6(kpi.roas(star_of(spark, d)), "roas")


@query(f"SELECT cohort, revenue, customers, round(revenue / customers, 6) AS ltv FROM ({LTV})")
def ltv_by_cohort(spark, d):
    return r6(kpi.ltv(star_of(spark, d)), "ltv")


@query("SELECT round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS repeat_purchase_rate FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def repeat_purchase_rate(spark, d):
    return r6(kpi.repeat_purchase_rate(star_of(spark, d)), "repeat_purchase_rate")


@query("SELECT round(avg(n), 6) AS average_order_frequency FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def order_frequency(spark, d):
    return r6(kpi.order_frequency(star_of(spark, d)), "average_order_frequency")


@query("SELECT round(avg(CASE WHEN last < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN 1.0 ELSE 0.0 END), 6) AS churn_rate FROM (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)")
def churn_rate(spark, d):
    return r6(kpi.churn_rate(star_of(spark, d), "2001-08-01"), "churn_rate")


@query(f"SELECT CAST(date_trunc('month', acquisition_date) AS DATE) AS cohort, CAST(floor(floor((epoch(order_date) - epoch(acquisition_date)) / 86400) / 30) AS BIGINT) AS period, count(DISTINCT o.customer_id) AS customers FROM {ORDERS} JOIN {CUSTOMERS} ON o.customer_id = c.customer_id GROUP BY 1, 2")
def retention_curves(spark, d):
    return kpi.retention(star_of(spark, d))


@query(f"SELECT channel, spend AS spend_amount FROM {MARKETING}")
def ad_spend(spark, d):
    return kpi.ad_spend(star_of(spark, d))


@query(f"SELECT v.channel, visits, orders, round(orders / visits, 6) AS conversion_rate FROM (SELECT c_mktsegment AS channel, count(DISTINCT event_id) AS visits FROM events JOIN customer ON c_custkey = user_id GROUP BY 1) v LEFT JOIN (SELECT channel, count(DISTINCT order_id) AS orders FROM {ORDERS} GROUP BY 1) g ON g.channel = v.channel")
def conversion_rate(spark, d):
    return r6(kpi.conversion_rate(star_of(spark, d)), "conversion_rate")


@query("SELECT user_id AS customer_id, ts AS date, event_type AS channel, event_id AS touch_id FROM events WHERE user_id = 7")
def customer_journey(spark, d):
    return kpi.journey(star_of(spark, d), "7")


@query(f"SELECT product_id, round(quantity * price, 4) AS revenue, round(quantity * cost, 4) AS cost, round(round(quantity * price, 4) - round(quantity * cost, 4), 4) AS gross_margin FROM {SOLD}")
def gross_margin(spark, d):
    return kpi.gross_margin(star_of(spark, d, lines=True)).withColumns({c: F.round(c, 4) for c in ("revenue", "cost", "gross_margin")})


@query("SELECT round((SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) - (SELECT CAST(sum(CAST(p_retailprice * 0.6 AS DECIMAL(18,4))) AS DOUBLE) FROM part) - (SELECT CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) FROM customer), 2) AS net_margin")
def net_margin(spark, d):
    return kpi.net_margin(star_of(spark, d)).withColumn("net_margin", F.round("net_margin", 2))


@query(f"SELECT round(a, 6) AS average_cac, round(b, 6) AS average_ltv, round(CASE WHEN a > 0 THEN b / a END, 6) AS ltv_to_cac FROM (SELECT avg(cac) AS a FROM ({CAC})), (SELECT avg(revenue / customers) AS b FROM ({LTV}))")
def unit_economics(spark, d):
    return r6(kpi.unit_economics(star_of(spark, d)), "average_cac", "average_ltv", "ltv_to_cac")


@query("SELECT p_partkey AS product_id, round(p_size * 100.0 / (p_retailprice - p_retailprice * 0.6), 6) AS break_even_units FROM part WHERE p_partkey = 5")
def break_even(spark, d):
    return r6(kpi.break_even(star_of(spark, d), 5), "break_even_units")
