"""Scans and sinks of the file formats in use: CSV, JSON lines, JSON documents, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stripped

PROPERTY_FIELDS = ("smiles", "property_category", "property_name", "value", "unit")


def property_records(spark: SparkSession, path: str) -> DataFrame:
    """The long-format property table: a header, UTF-8 with or without a BOM, all cells stripped, null as empty."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in PROPERTY_FIELDS])
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, enforceSchema=True)
    return rows.select(*(stripped(F.col(f)).alias(f) for f in PROPERTY_FIELDS))


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines without blank ones; a row that lacks a required field raises an error that names the field and file."""
    rows = spark.read.schema(schema).json(path)
    for f in required:
        message = F.concat(F.lit(f"missing {f} in "), F.col("_metadata.file_path"))
        rows = rows.withColumn(f, F.when(F.col(f).isNull(), F.raise_error(message).cast(schema[f].dataType)).otherwise(F.col(f)))
    return rows


def json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional(spark: SparkSession, path: str, schema: T.StructType, read=json_lines) -> DataFrame:
    """An empty table where the path does not exist, in whichever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return read(spark, path, schema) if found else spark.createDataFrame([], schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Fields in alphabetical order, nulls kept."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    rows.select(*fields).write.mode("overwrite").csv(path, header=True, escape='"')


def write_corpus(rows: DataFrame, path: str, value: str, split: str = "train") -> None:
    """One string a line, of one split only."""
    rows.filter(F.col("split") == split).select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)
