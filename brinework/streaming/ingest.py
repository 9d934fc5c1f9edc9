"""Files that land in a folder, taken up once each: the streaming form of the revenue query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators.kpi import period_of


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def revenue_stream(orders: DataFrame, period: str = "daily", late: str = "7 days") -> DataFrame:
    """(period, revenue) over a stream with order_date and total_amount; a period ends when ``late`` has passed."""
    ts = F.col("order_date").cast("timestamp")
    rows = orders.withColumn("_ts", ts).withWatermark("_ts", late)
    if period == "monthly":  # a month is no fixed window
        return rows.groupBy(period_of("_ts", period).alias("period")).agg(F.sum("total_amount").alias("revenue"))
    width = {"daily": "1 day", "weekly": "7 days"}[period]
    start = "4 days" if period == "weekly" else "0 days"  # 1970-01-05 was a Monday
    return rows.groupBy(F.window("_ts", width, width, start)).agg(F.sum("total_amount").alias("revenue")).select(F.col("window.start").cast("date").alias("period"), "revenue")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
