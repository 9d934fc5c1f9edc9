"""The dataset catalog, saved statistics, and the audit log of cleaning runs, as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.operators.relational import page, search

#: What is known of a cleaning run. Metrics are numbers by name, alerts and steps texts in order.
AUDIT = (
    "session_id string, started_at timestamp, completed_at timestamp, status string, config string, rows_before long, rows_after long, steps array<string>, "
    "dataset string, columns_before long, columns_after long, log array<string>, metrics map<string, double>, alerts array<string>, source_path string, target_path string, error string, user string"
)


def entry(df: DataFrame, name: str) -> DataFrame:
    """One catalog row of a dataset: counts, missing cells, duplicates, column info as JSON."""
    from brinework.operators.quality import catalog_score

    info = ",".join(f'{{"name":"{c}","type":"{k}"}}' for c, k in df.dtypes)
    return catalog_score(df).select(F.lit(name).alias("name"), F.col("rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"), F.lit(f"[{info}]").alias("columns_info"), F.col("missing_cells").alias("missing_values_count"), F.col("duplicate_rows").alias("duplicate_rows_count"), F.col("score").alias("data_quality_score"))


def totals(catalog: DataFrame, size: str = "row_count") -> DataFrame:
    """(datasets, total, average, largest) of the catalog."""
    return catalog.agg(F.count("*").alias("datasets"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.avg(size).alias("average"), F.max_by("name", F.struct(size, "name")).alias("largest"))


def find(catalog: DataFrame, text: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of the datasets with ``text`` in the name or column info."""
    return page(search(catalog, text, ["name", "columns_info"]), number, size, ["name"])


def save_statistics(stats: DataFrame, path: str, dataset: str) -> None:
    """Replace the statistics of one dataset in a table partitioned by dataset; others stay."""
    out = stats.withColumn("dataset", F.lit(dataset))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def recent(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest datasets, ties by name."""
    return catalog.orderBy(F.desc_nulls_last("created_at"), "name").limit(n)


def by_size(catalog: DataFrame, size: str = "file_size") -> DataFrame:
    """All datasets, largest first, an unknown size as 0, ties by name."""
    return catalog.orderBy(F.desc(F.coalesce(size, F.lit(0))), "name")


def tagged(catalog: DataFrame, tag: str) -> DataFrame:
    """Datasets with the tag among their ``tags``."""
    return catalog.where(F.array_contains("tags", tag))


def ask(spark: SparkSession, sql: str, values: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """SQL over tables of metadata, which it names in braces as {datasets}; ``values`` stand for its named parameters as
    :least and are never read as SQL."""
    return spark.sql(sql, args=dict(values or {}), **tables)


def statistics_table(stats: DataFrame, text: str = "", kind: str | None = None, order: str = "column", descending: bool = False) -> DataFrame:
    """Statistics (column, type, ...) of the columns with ``text`` in their name, in any case, and of type ``kind`` if any, by
    ``order``: a column without a value there ranks lowest. Ties go by name."""
    out = search(stats, text, ["column"]) if text else stats
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return out.orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_first(order), "column")


def log_run(spark: SparkSession, path: str, row: Mapping | tuple) -> None:
    """Append one cleaning run to the audit log: values by name, or in the order of ``AUDIT``; what is not given is null."""
    names = spark.createDataFrame([], AUDIT).columns
    given = row if isinstance(row, Mapping) else dict(zip(names, row))
    if unknown := set(given) - set(names):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    spark.createDataFrame([tuple(given.get(c) for c in names)], AUDIT).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, n: int = 10, session: str | None = None) -> DataFrame:
    """The latest runs, or those of a session."""
    log = spark.read.schema(AUDIT).parquet(path)
    log = log.withColumns({
        "seconds": F.timestamp_diff("MILLISECOND", "started_at", "completed_at") / 1000,
        "rows_removed": F.col("rows_before") - F.col("rows_after"),
        "columns_removed": F.col("columns_before") - F.col("columns_after"),
    })
    return (log.where(F.col("session_id") == session) if session else log).orderBy(F.desc("started_at"), "session_id").limit(n)


def export_run(spark: SparkSession, path: str, session: str, to: str) -> None:
    """The runs of a session as a folder of JSON lines, with the time of the export."""
    history(spark, path, 1_000, session).withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").json(to)
