"""The queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import nfc
from ..session import ship, table
from . import canonical, crosssplit, lookalike, mixing, mojibake, neardup, packing, subjects, tokens


def p1_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_budget(tokens.document_tokens(table(spark, sf, "corpus_docs"), table(spark, sf, "corpus_entries")))


def p1_documents_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_budget(tokens.document_tokens(table(spark, sf, "documents"), table(spark, sf, "corpus_entries"), "source"))


def p1_record_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf, "corpus_docs"), table(spark, sf, "corpus_entries"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf, "corpus_docs"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf, "corpus_docs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, sf, "corpus_docs"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, sf, "corpus_docs"))


def p3_canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "corpus_docs").select("doc_id", "text", "loaded_at")
    return canonical.with_canonical(docs).select("doc_id", "loaded_at", "canonical_text", (F.col("text") != F.col("canonical_text")).alias("changed"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.as_pairs(crosssplit.cross_split_pairs(table(spark, sf, "corpus_docs")))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.overlap_classes(table(spark, sf, "corpus_docs"))


def p4_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, sf, "corpus_docs"))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled_records(table(spark, sf, "corpus_docs"), table(spark, sf, "corpus_entries"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("doc_id").distinct()


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).dropDuplicates(["doc_id"])


def p6_placements(spark: SparkSession, sf: str) -> DataFrame:
    return packing.placements(table(spark, sf, "documents"), table(spark, sf, "pack_capacities"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p6_placements(spark, sf))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def _subject_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("documents", "subject_labels", "subject_areas")]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(*_subject_tables(spark, sf)).select("doc_id", "subject")


def p8_subject_shares(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.subject_shares(*_subject_tables(spark, sf))


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, sf))


# What SQL can follow: the parts around the operators, and what must hold of their results.
def _cube(spark: SparkSession, sf: str, documents: str, name: str) -> DataFrame:
    found = tokens.described(table(spark, sf, documents), table(spark, sf, "corpus_entries"), name)
    return found.cube("entry", "lang", "kind", "slot").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("documents"))


def p1_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _cube(spark, sf, "corpus_docs", "name")


def p1_documents_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _cube(spark, sf, "documents", "source")


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Records, those whose consistent form is not composed or not its own form, and plain ASCII ones that were changed."""
    docs = table(spark, sf, "corpus_docs").where("text is not null").select("text")
    formed = canonical.with_canonical(canonical.with_canonical(docs, "text", "once"), "once", "twice")
    plain = F.col("text").rlike("^[\\x20-\\x7E\\n]*\\z")
    return formed.agg(F.count("*").alias("records"), F.count_if(F.col("once") != nfc(F.col("once"))).alias("not_composed"), F.count_if(F.col("once") != F.col("twice")).alias("not_stable"), F.count_if(plain).alias("plain"), F.count_if(plain & (F.col("once") != F.col("text"))).alias("plain_changed"))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, sf, "corpus_docs")).select("split", "entry", "records")


def p5_lost(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled records whose stored text has lost bytes."""
    lost = table(spark, sf, "corpus_docs").where(F.contains("text", F.lit(mojibake.LOST))).select("doc_id").distinct()
    return p5_found(spark, sf).join(lost, "doc_id")


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    placed = p6_placements(spark, sf)
    boxes = placed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"))
    over = boxes.groupBy("pack_name").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_full"))
    per = placed.groupBy("pack_name", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") < F.col("capacity_tokens")).alias("short"))
    divided = F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")))
    sums = per.groupBy("pack_name", "capacity_tokens").agg(F.count("*").alias("documents"), divided.alias("divided_without_need"), F.count_if((F.col("pieces") > 1) & (F.col("short") > 1)).alias("whole_pieces_not_full"))
    return sums.join(over, "pack_name").select("pack_name", "capacity_tokens", "documents", "over_full", "divided_without_need", "whole_pieces_not_full")


def p7_goals(spark: SparkSession, sf: str) -> DataFrame:
    found = p7_shares(spark, sf)
    return found.select("mix_name", "source", "target_share", "max_repeats", (F.col("available") > 0).alias("has_documents"), F.round("goal", 9).alias("goal"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """By mix: sources used more often than allowed, documents chosen twice, sources off their budget by more than a document."""
    docs = table(spark, sf, "documents")
    chosen, shares = mixing.mixed(docs, table(spark, sf, "mix_targets"))
    twice = chosen.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n")).groupBy("mix_name").agg(F.count_if(F.col("n") > 1).alias("twice"))
    longest = mixing.places(docs).groupBy("source").agg(F.max("tokens").alias("longest"))
    off = F.abs(F.col("tokens") - F.col("budget")) > F.coalesce("longest", F.lit(0))
    sums = shares.join(longest, "source", "left").groupBy("mix_name").agg(F.count_if(F.col("most_repeats") > F.col("max_repeats")).alias("over_repeated"), F.count_if(off).alias("off_budget"))
    return sums.join(twice, "mix_name", "left").select("mix_name", "over_repeated", F.coalesce("twice", F.lit(0)).alias("twice"), "off_budget")


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    _, labels, areas = _subject_tables(spark, sf)
    known = [r[0] for r in areas.where("subject is not null").select("subject").distinct().collect()]  # a few rows
    return subjects.labels_of(labels, known).select("doc_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects there are, and rows of the result with another one, given twice, or below a fifth."""
    areas = table(spark, sf, "subject_areas").where("subject is not null").select("subject").distinct()
    found = subjects.document_subjects(*_subject_tables(spark, sf))
    unknown = found.join(F.broadcast(areas), "subject", "left_anti").agg(F.count("*").alias("unknown_subjects"))
    rows = found.groupBy("doc_id", "subject").agg(F.count("*").alias("n"), F.min("share").alias("share")).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("share") < 0.2).alias("below_a_fifth"))
    return areas.agg(F.count("*").alias("subjects")).crossJoin(unknown).crossJoin(rows)


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return query(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_token_budget,
        p1_documents_token_budget,
        p1_record_tokens,
        p2_found,
        p2_classes,
        p3_found,
        p3_classes,
        p3_canonical_text,
        p4_found,
        p4_classes,
        p4_overlap_report,
        p5_found,
        p5_restored,
        p6_placements,
        p6_fill,
        p7_selection,
        p7_shares,
        p8_found,
        p8_subject_shares,
        p8_composition,
        p1_cube,
        p1_documents_cube,
        p3_checks,
        p4_records,
        p5_lost,
        p6_checks,
        p7_goals,
        p7_checks,
        p8_labels,
        p8_checks,
    ]
    return {q.__name__: _ready(q) for q in named}
