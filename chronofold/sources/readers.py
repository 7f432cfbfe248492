"""Tables that series come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, drop_nulls: bool = False) -> DataFrame:
    """Comma-separated values with a header line; a schema spares the pass that infers one."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.na.drop("any") if drop_nulls else df


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Measurements as ``location;temperature`` lines without a header."""
    return spark.read.option("sep", ";").schema("location string, temperature double").csv(path)


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from literals, with its order in ``ord``."""
    numbered = [(*r, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(numbered, f"{schema}, ord long")


def write_table(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Features as Parquet; ``rows_per_file`` keeps files of very wide rows small."""
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)
