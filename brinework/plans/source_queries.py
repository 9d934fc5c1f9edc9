"""Queries of readers and writers over the test tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinework.plans.registry import query
from brinework.sources import excel


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, o_orderkey % 3 = 0 AS third FROM orders
""")
def excel_orders(spark, d):
    """All orders as workbooks of at most 4,000 rows, read back as one table."""
    o = t(spark, d, "orders")
    some = o.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), (F.col("o_orderkey") % 3 == 0).alias("third"))
    return excel.table_of(excel.workbooks(some, rows=4000))
