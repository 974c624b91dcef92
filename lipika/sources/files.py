"""Sources: documents from JSON lines, loose text lines, slot corpora and registered corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import loose_text
from ..session import few, file_system

DOCUMENT = "doc_id string, kind string, text string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines file; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path).where("doc_id is not null or text is not null")


def read_loose(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """(text): one row per usable line of JSON-lines or plain text files."""
    return spark.read.text(path).select(loose_text(F.col("value"), key).alias("text")).where("text is not null")


def read_slot_corpus(spark: SparkSession, path: str, slot: str) -> DataFrame:
    """The runs of one slot; only its folder is read."""
    return spark.read.parquet(path).where(F.col("slot") == slot)


def read_registered(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """(path, text): the lines of all files below the paths whose name matches."""
    name = pattern.rsplit("/", 1)[-1]
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


ENTRIES = 10_000  # registered corpora; more are an error


def read_registry(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """(name, path, line): the lines of all registered corpora (name, paths, glob_pattern); paths that are not there are skipped."""
    found = None
    for e in few(entries.select("name", "paths", "glob_pattern"), ENTRIES, "registered corpora"):
        there = [p for p in e["paths"] or () if exists(spark, p)]
        if there:
            one = read_registered(spark, there, e["glob_pattern"]).select(F.lit(e["name"]).alias("name"), "path", F.col("text").alias("line"))
            found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], "name string, path string, line string") if found is None else found


def exists(spark: SparkSession, path: str) -> bool:
    target, system = file_system(spark, path)
    return system.exists(target)


def load_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The documents at ``path``; where there are none, those of ``make``, written there first. What is there stays."""
    if not exists(spark, f"{path}/_SUCCESS"):
        write_documents(make(), path)
    return read_documents(spark, path)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "text").write.mode("overwrite").json(path)
