"""Reading and writing of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; its columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delimited(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Delimited files as strings, without a pass to guess types; columns are Column1..n without a header."""
    df = spark.read.csv(path, sep=separator, header=header, inferSchema=False)
    return df if header else df.toDF(*(f"Column{k}" for k in range(1, len(df.columns) + 1)))


def save(df: DataFrame, name: str, mode: str = "error") -> None:
    """Stores rows as a table of the catalog, as procedures with an output table do."""
    df.write.mode(mode).saveAsTable(name)
