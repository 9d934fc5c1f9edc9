"""The e-commerce star: orders, customers, products, marketing, and the side tables touchpoints and visits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {
    "orders": {"order_id", "customer_id", "order_date", "total_amount"},
    "customers": {"customer_id", "acquisition_date", "acquisition_channel"},
    "products": {"product_id", "cost", "price"},
    "marketing": {"channel", "spend_amount"},
}
PRODUCTS = "array<struct<product_id: long, quantity: double>>"


@dataclass(frozen=True)
class Star:
    """Four related tables; a missing required column is an error at once. Dates given as text are parsed."""

    orders: DataFrame
    customers: DataFrame
    products: DataFrame
    marketing: DataFrame
    touchpoints: DataFrame | None = None
    visits: DataFrame | None = None

    def __post_init__(self):
        for name, columns in REQUIRED.items():
            if lost := sorted(columns - set(getattr(self, name).columns)):
                raise ValueError(f"{name} lacks {', '.join(lost)}")
        for name, column in (("orders", "order_date"), ("customers", "acquisition_date")):
            df = getattr(self, name)
            if dict(df.dtypes)[column] == "string":
                object.__setattr__(self, name, df.withColumn(column, F.to_timestamp(column)))
        if dict(self.orders.dtypes).get("products") == "string":
            object.__setattr__(self, "orders", self.orders.withColumn("products", F.from_json("products", PRODUCTS)))


def read_star(spark: SparkSession, folder: str) -> Star:
    """The star from CSV files with headers, one for each table; touchpoints and visits may be absent."""
    csv = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)

    def side(name):
        try:
            return csv(name)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    return Star(*map(csv, REQUIRED), side("touchpoints"), side("visits"))


def _parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    """Orders of the test tables; with ``lines``, their products as an array."""
    o = _parquet(spark, sf_dir, "orders")
    c = _parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("channel"))
    out = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("total_amount"), "channel")
    if lines:
        line = _parquet(spark, sf_dir, "lineitem")
        items = line.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))).alias("products"))
        out = out.join(items, "order_id", "left")
    return out


def star_of(spark: SparkSession, sf_dir: str, lines: bool = False) -> Star:
    """The star built from the test tables."""
    o = _parquet(spark, sf_dir, "orders")
    c = _parquet(spark, sf_dir, "customer")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    shift = F.make_dt_interval((F.col("c_custkey") % 90 - 30).cast("int"))
    customers = c.join(first, c.c_custkey == first.o_custkey).select(F.col("c_custkey").alias("customer_id"), (F.col("first") + shift).alias("acquisition_date"), F.col("c_mktsegment").alias("acquisition_channel"))
    products = _parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_retailprice") * 0.6).alias("cost"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"), (F.col("p_size") * 100.0).alias("fixed_costs"))
    marketing = c.select(F.col("c_mktsegment").alias("channel"), F.abs("c_acctbal").alias("spend_amount"))
    e = _parquet(spark, sf_dir, "events")
    touchpoints = e.select(F.col("user_id").alias("customer_id"), F.col("ts").alias("date"), F.col("event_type").alias("channel"), F.col("event_id").alias("touch_id"))
    visits = e.join(c, e.user_id == c.c_custkey).select(F.col("c_mktsegment").alias("channel"), F.col("event_id").alias("visit_id"), F.col("user_id").alias("customer_id"))
    return Star(orders(spark, sf_dir, lines), customers, products, marketing, touchpoints, visits)
