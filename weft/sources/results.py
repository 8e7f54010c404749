"""Result sinks: CSV and JSON lines, written by Spark in parts and read again with their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_results(rows: DataFrame, path: str, form: str = "json") -> StructType:
    """Write rows as ``csv`` (with a header, nulls as \\N) or ``json`` and return the schema to read them with; an existing path is an error."""
    w = rows.write.mode("errorifexists")
    w.option("header", True).option("nullValue", "\\N").csv(path) if form == "csv" else w.option("ignoreNullFields", False).json(path)
    return rows.schema


def read_results(spark: SparkSession, path: str, schema: StructType, form: str = "json") -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("header", True).option("nullValue", "\\N").csv(path) if form == "csv" else r.json(path)
