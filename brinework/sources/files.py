"""Readers and writers by format."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.functions.columns import nan_to_null

FORMATS = ("csv", "json", "jsonl", "parquet", "orc")


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """A table from CSV with a header, JSON records, JSON lines, Parquet or ORC; NaN is read as null. Without an
    ``encoding`` each CSV file is UTF-8, or Latin-1 where it is not valid UTF-8."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema else reader.option("inferSchema", True)
        groups = {encoding: [path]} if encoding else csv_encodings(spark, path)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (nan_to_null(reader.option("encoding", kind).csv(files)) for kind, files in groups.items()))
    if kind in ("json", "jsonl"):
        return nan_to_null(reader.option("multiLine", kind == "json").json(path))
    return nan_to_null(reader.format(kind).load(path))


def csv_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of ``path`` by encoding: UTF-8 where every line decodes as such, else Latin-1, which any bytes do. Where all
    files are of one kind, the path stands for them."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    odd = [unquote(r["file"]) for r in lines.where("not ok").select("file").distinct().collect()]
    if not odd:
        return {"UTF-8": [path]}
    plain = [unquote(r["file"]) for r in lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).where("ok").collect()]
    return ({"UTF-8": plain} if plain else {}) | {"ISO-8859-1": odd}


def read_json_columns(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """A table from JSON files of the form {column: {row: value}}; see ``json_columns``."""
    return json_columns(spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), index)


def json_columns(texts: DataFrame, index: str | None = None) -> DataFrame:
    """A table from (file, text) of the form {column: {row: value}}, one for each file; with ``index`` the row labels are a
    column of that name. A column has the type that holds its values of all files: whole numbers, doubles, booleans or
    texts, and text for anything else, as for values of different types. What a row lacks is null. A text is one value, so
    a large table is one of many files. The rows of a file whose columns all have the same rows are put together in place, those of
    others by (file, row)."""
    parsed = texts.select("file", F.parse_json("text").alias("v"))
    cells_of = lambda some: texts.sparkSession.sql("SELECT file, r.key AS label, c.key AS name, r.value AS value FROM {parsed}, LATERAL variant_explode(v) AS c, LATERAL variant_explode(c.value) AS r", parsed=some)
    found = {r["name"]: r["kind"] for r in cells_of(parsed).groupBy("name").agg(F.schema_of_variant_agg("value").alias("kind")).collect()}
    # where all columns of a file have the same rows, as they mostly do, its rows are put together where the file is; the keys
    # of a variant are in order
    maps = parsed.select("file", "v", F.variant_get("v", "$", "map<string, map<string, variant>>").alias("m"))
    keys = F.transform(F.map_values("m"), F.map_keys)
    even = maps.withColumn("k", F.coalesce(F.get(keys, F.lit(0)), F.array().cast("array<string>"))).withColumn("even", F.forall(keys, lambda x: x == F.col("k")))
    names, none = sorted(found), F.array().cast("array<variant>")
    place = {c: f"_{i}" for i, c in enumerate(names)}
    aligned = even.where("even").select(F.explode(F.arrays_zip(F.col("k").alias("label"), *(F.coalesce(F.map_values(F.col("m")[c]), none).alias(p) for c, p in place.items()))).alias("r")).select("r.label", *(F.col(f"r.{p}").alias(c) for c, p in place.items()))
    ragged = cells_of(even.where(~F.coalesce(F.col("even"), F.lit(False))).select("file", "v")).groupBy("file", "label").pivot("name", names).agg(F.first("value")).drop("file")
    rows = aligned.unionByName(ragged)

    def typed(c: str, kind: str):
        v = F.col("`" + c.replace("`", "``") + "`")
        if kind.startswith("DECIMAL") or kind == "DOUBLE":
            return F.variant_get(v, "$", "double").alias(c)
        if kind in ("BIGINT", "BOOLEAN", "STRING"):
            return F.variant_get(v, "$", kind.lower()).alias(c)
        plain = F.schema_of_variant(v).isin("STRING", "VOID")
        return F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)).alias(c)

    return rows.select(*([F.col("label").alias(index)] if index else []), *(typed(c, k) for c, k in found.items()))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", compression: str | None = None, by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    else:
        writer.format(kind).save(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def known_files(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content the catalog has already."""
    return found.join(catalog.select("sha256").distinct(), "sha256", "left_semi")
