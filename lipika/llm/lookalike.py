"""Problem 3, second half: records whose stored texts differ and whose consistent form is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import text_looks
from .similarity import EXPAND


def look_alike_classes(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """One row per record and split of those that look like a record with other characters: digests of its consistent
    form (look) and of its text (raw), the copies of that text, and their representative in look_alike_pairs."""
    looks = materialize(text_looks(docs, least_words).distinct(), "looks")
    several = looks.groupBy("look").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most").select("look")
    copies = looks.groupBy("look", "raw").agg(F.count("*").alias("copies"), F.min("doc_id").alias("representative"))
    members = looks.join(several, "look").join(copies, ["look", "raw"])
    splits = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("split").cast("string").alias("split")).distinct()
    return members.join(splits, "doc_id").select("doc_id", "split", F.hex("look").alias("look"), F.hex("raw").alias("raw"), "copies", "representative")


def look_alike_pairs(docs: DataFrame, least_words: int = 8, expand: int = EXPAND) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first: records that look the same but are not the same characters.

    Only digests are shuffled; a look that many records have is one key of joins that adaptive execution splits. Of more than ``expand`` records with the very same characters the one with the least
    doc_id stands for all in these pairs. Null ids or texts and texts below ``least_words`` words are in no pair.
    """
    looks = materialize(text_looks(docs, least_words).distinct(), "looks")
    sizes = looks.groupBy("look", "raw").agg(F.count("*").alias("size"), F.min("doc_id").alias("first"))
    several = sizes.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    shown = looks.join(several, "look").join(sizes, ["look", "raw"]).where((F.col("size") <= expand) | (F.col("doc_id") == F.col("first"))).select("look", "raw", "doc_id")
    met = shown.alias("x").join(shown.alias("y"), F.expr("x.look = y.look and x.raw <> y.raw and x.doc_id < y.doc_id"))
    return met.select(F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b")).distinct()
