"""Catalog scans: the tables of a folder, their columns and how many rows they have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.session import table

COLUMNS = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"


def columns(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """A row for each column of the named tables; only schemas are read."""
    rows = [(n, k + 1, f.name, f.dataType.simpleString(), f.nullable) for n in names for k, f in enumerate(table(spark, sf_dir, n).schema)]
    return spark.createDataFrame(rows, COLUMNS)


def row_counts(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """``(table_name, n)``: rows of each named table, from the counts in the files' footers."""
    counts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts)
