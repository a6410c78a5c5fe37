"""Tables of addresses from files and back; any format Spark reads. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streetloom.operators.lastline import FIELDS

RAW = "addr_id long, raw string"
STRUCTURED = "addr_id long, type string, " + ", ".join(f"{f} string" for f in FIELDS)


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> DataFrame:
    if format == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'} | options
    return spark.read.schema(schema).format(format).options(**options).load(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    if format == "csv":
        options = {"header": True, "escape": '"'} | options
    w = df.write.format(format).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
