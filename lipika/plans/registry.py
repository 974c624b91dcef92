"""The register of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return f


def spread(df: DataFrame) -> DataFrame:
    """Few files on many cores: share the rows out. Larger inputs have splits enough and stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def given(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text is not null")


def joined(ids) -> Column:
    return F.md5(F.array_join(ids, " "))
