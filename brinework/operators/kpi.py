"""Business KPIs over the star. Each is a lazy DataFrame; null group keys are dropped, sums of nothing are 0."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.sources.star import Star

PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}


def period_of(ts: Column | str, period: str) -> Column:
    """First day of the day, Monday week or month of a timestamp."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    return F.date_trunc(PERIODS[period], ts).cast("date")


def money(x: Column | str) -> Column:
    """Sum of amounts to ten places, the same in any order of the rows; 0 for none."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(x.try_cast("decimal(38,10)")), F.lit(0)).cast("double")


def revenue(star: Star, period: str = "daily", start: date | datetime | str | None = None, end: date | datetime | str | None = None) -> DataFrame:
    """(period, revenue) of orders from ``start`` to ``end``; an end date means its midnight."""
    o = star.orders
    if start is not None:
        o = o.where(F.col("order_date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        o = o.where(F.col("order_date") <= F.lit(end).cast("timestamp_ntz"))
    o = o.withColumn("period", period_of("order_date", period)).where("period is not null")
    return o.groupBy("period").agg(money("total_amount").alias("revenue"))


def orders_and_aov(star: Star, period: str = "daily") -> DataFrame:
    """(period, orders, aov): distinct orders, and the mean amount of a row."""
    o = star.orders.withColumn("period", period_of("order_date", period)).where("period is not null")
    return o.groupBy("period").agg(F.count_distinct("order_id").alias("orders"), F.try_divide(money("total_amount"), F.count("total_amount")).alias("aov"))


def aov(star: Star, period: str = "daily") -> DataFrame:
    return orders_and_aov(star, period).select("period", "aov")


def new_vs_returning(star: Star) -> DataFrame:
    """(new_customers, returning_customers) as first rows against the rest, which is 0 where no id is null; and
    ``repeat_customers``, those with more than one order."""
    per = star.orders.groupBy("customer_id").agg(F.count("*").alias("n"))
    new = F.count("customer_id")
    return per.agg(new.alias("new_customers"), (F.count("customer_id") - new).alias("returning_customers"), F.count_if(F.col("customer_id").isNotNull() & (F.col("n") > 1)).alias("repeat_customers"))


def sold(star: Star) -> DataFrame:
    """(product_id, quantity) of all order lines."""
    return star.orders.select(F.explode("products").alias("line")).select("line.*")


def sold_quantities(star: Star) -> DataFrame:
    """Units by product: summed before the join with the catalog, so one product's lines never meet in one task."""
    return sold(star).where("product_id is not null").groupBy("product_id").agg(F.sum("quantity").alias("quantity"))


def top_products(star: Star, n: int = 10) -> DataFrame:
    """(product_id, revenue, category) of the ``n`` products with most revenue at catalog prices; ties by product_id."""
    priced = sold_quantities(star).join(star.products, "product_id")
    value = (F.col("quantity") * F.col("price")).alias("revenue")
    return priced.select("product_id", value, "category").orderBy(F.desc("revenue"), "product_id").limit(n)


def ad_spend(star: Star) -> DataFrame:
    return star.marketing.where("channel is not null").groupBy("channel").agg(money("spend_amount").alias("spend_amount"))


def cac(star: Star, name: str = "cac") -> DataFrame:
    """(channel, name): spend by customers acquired; 0 for a channel without customers."""
    won = star.customers.groupBy(F.col("acquisition_channel").alias("channel")).agg(F.count("customer_id").alias("customers"))
    spent = ad_spend(star).join(won, "channel", "left")
    return spent.select("channel", F.coalesce(F.try_divide("spend_amount", F.nullif("customers", F.lit(0))), F.lit(0.0)).alias(name))


def cost_per_acquisition(star: Star) -> DataFrame:
    return cac(star, "cpa")


def cohorts(star: Star) -> DataFrame:
    """(cohort, customers) by month of acquisition."""
    c = star.customers.withColumn("cohort", period_of("acquisition_date", "monthly")).where("cohort is not null")
    return c.groupBy("cohort").agg(F.count_distinct("customer_id").alias("customers"))


def attribution(star: Star, model: str = "first_touch", order_by: tuple[str, ...] = ("date", "touch_id")) -> DataFrame:
    """(customer_id, channel) of the first or last touch, or all distinct pairs for any other model. Ties of date go by
    the further columns of ``order_by``."""
    t = star.touchpoints
    if model not in ("first_touch", "last_touch"):
        return t.select("customer_id", "channel").distinct()
    pick = F.min_by if model == "first_touch" else F.max_by
    return t.where("customer_id is not null").groupBy("customer_id").agg(pick("channel", F.struct(*order_by)).alias("channel"))


def roas(star: Star) -> DataFrame:
    """(channel, revenue, spend_amount, roas): revenue by spend; null without spend."""
    got = star.orders.where("channel is not null").groupBy("channel").agg(money("total_amount").alias("revenue"))
    both = got.join(ad_spend(star), "channel", "left")
    return both.select("channel", "revenue", "spend_amount", F.when(F.col("spend_amount") > 0, F.try_divide("revenue", "spend_amount")).alias("roas"))


def _with_cohort(star: Star, how: str) -> DataFrame:
    c = star.customers.select("customer_id", "acquisition_date", period_of("acquisition_date", "monthly").alias("cohort"))
    return star.orders.join(c, star.orders.customer_id.eqNullSafe(c.customer_id), how).drop(c.customer_id)


def ltv(star: Star) -> DataFrame:
    """(cohort, revenue, customers, ltv): amounts of a cohort by its customers with orders."""
    by = _with_cohort(star, "left").where("cohort is not null").groupBy("cohort")
    out = by.agg(money("total_amount").alias("revenue"), F.count_distinct("customer_id").alias("customers"))
    return out.withColumn("ltv", F.try_divide("revenue", "customers"))


def _per_customer(star: Star) -> DataFrame:
    return star.orders.where("customer_id is not null").groupBy("customer_id").agg(F.count("*").alias("n"), F.max("order_date").alias("last"))


def repeat_purchase_rate(star: Star) -> DataFrame:
    return _per_customer(star).agg(F.coalesce(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("repeat_purchase_rate"))


def order_frequency(star: Star) -> DataFrame:
    return _per_customer(star).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_order_frequency"))


def churn_rate(star: Star, reference: date | datetime | str, days: int = 90) -> DataFrame:
    """Share of customers whose last order is before ``reference`` less ``days``; 0 without customers."""
    cutoff = F.lit(reference).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return _per_customer(star).agg(F.coalesce(F.avg(F.when(F.col("last") < cutoff, 1.0).otherwise(0.0)), F.lit(0.0)).alias("churn_rate"))


def retention(star: Star, days: int = 30) -> DataFrame:
    """(cohort, period, customers): whole periods of ``days`` since acquisition, negative before it."""
    both = _with_cohort(star, "inner").where("cohort is not null")
    # without a zone, as a day on which clocks change is a day too
    micros = F.timestamp_diff("MICROSECOND", F.col("acquisition_date").cast("timestamp_ntz"), F.col("order_date").cast("timestamp_ntz"))
    period = F.floor(F.floor(micros / 86_400_000_000) / days).cast("long")
    return both.withColumn("period", period).where("period is not null").groupBy("cohort", "period").agg(F.count_distinct("customer_id").alias("customers"))


def conversion_rate(star: Star) -> DataFrame:
    """(channel, visits, orders, conversion_rate): distinct orders by distinct visits; null without orders."""
    seen = star.visits.where("channel is not null").groupBy("channel").agg(F.count_distinct("visit_id").alias("visits"))
    made = star.orders.where("channel is not null").groupBy("channel").agg(F.count_distinct("order_id").alias("orders"))
    return seen.join(made, "channel", "left").withColumn("conversion_rate", F.try_divide("orders", "visits"))


def journey(star: Star, customer_id, order_by: tuple[str, ...] = ("date", "touch_id")) -> DataFrame:
    """All touches of one customer in order; the id is cast to the column's type."""
    kind = dict(star.touchpoints.dtypes)["customer_id"]
    return star.touchpoints.where(F.col("customer_id") == F.lit(customer_id).cast(kind)).orderBy(*order_by)


def gross_margin(star: Star) -> DataFrame:
    """(product_id, revenue, cost, gross_margin) of sold units at catalog price and cost."""
    both = sold_quantities(star).join(star.products, "product_id")
    out = both.select("product_id", (F.col("quantity") * F.col("price")).alias("revenue"), (F.col("quantity") * F.col("cost")).alias("cost"))
    return out.withColumn("gross_margin", F.col("revenue") - F.col("cost"))


def net_margin(star: Star) -> DataFrame:
    """Order totals less one unit's cost of each catalog product, less spend."""
    one = [star.orders.agg(money("total_amount").alias("revenue")), star.products.agg(money("cost").alias("cost")), star.marketing.agg(money("spend_amount").alias("spend"))]
    return one[0].join(one[1]).join(one[2]).select((F.col("revenue") - F.col("cost") - F.col("spend")).alias("net_margin"))


def unit_economics(star: Star) -> DataFrame:
    """(average_cac, average_ltv, ltv_to_cac): unweighted means over channels and cohorts; no ratio for a CAC of 0."""
    a, b = cac(star).agg(F.avg("cac").alias("average_cac")), ltv(star).agg(F.avg("ltv").alias("average_ltv"))
    return a.join(b).withColumn("ltv_to_cac", F.when(F.col("average_cac") > 0, F.try_divide("average_ltv", "average_cac")))


def break_even(star: Star, product_id) -> DataFrame:
    """(product_id, break_even_units): fixed costs by unit margin; null for no margin, and for no such product."""
    fixed = F.coalesce("fixed_costs", F.lit(0.0)) if "fixed_costs" in star.products.columns else F.lit(0.0)
    p = star.products.where(F.col("product_id") == F.lit(product_id)).select(F.try_divide(fixed, F.nullif(F.col("price") - F.col("cost"), F.lit(0.0))).alias("break_even_units"))
    kind = dict(star.products.dtypes)["product_id"]
    return star.products.sparkSession.range(1).select(F.lit(product_id).cast(kind).alias("product_id")).join(p, how="left")
