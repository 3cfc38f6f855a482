"""Documents from JSON text, Parquet, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_json_array(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Documents of JSON arrays held in a column; text that isn't such an array is an error."""
    parsed = F.from_json(F.col(column), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return texts.select(F.inline(parsed))


def from_json_text(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Documents of one JSON array."""
    return from_json_array(spark.createDataFrame([(text,)], "value string"), schema)


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Documents of files; ``form`` is any that Spark reads."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
