"""Corpus operators: extraction, splits, cuts by running sums, held-out sets, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words
from ..session import materialize
from .prefix import with_before, with_number


def loose_text(line: Column, key: str = "text") -> Column:
    """The text of a line: of a JSON object the first non-empty of ``key``, content and target, of anything else the line
    itself; null for blank lines and objects without text."""
    own = strip(line)
    is_object = own.startswith("{") & own.endswith("}")
    field = [F.nullif(F.get_json_object(own, f"$.{k}"), F.lit("")) for k in (key, "content", "target")]
    parsed = F.try_parse_json(own).isNotNull()
    return F.when(is_object & parsed, F.coalesce(*field)).otherwise(F.nullif(own, F.lit("")))


def running_cut(docs: DataFrame, size: Column, limit: Column | int, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """Rows in order until their sizes reach ``limit``, with the row that crosses it. Per group if groups are given."""
    return with_before(docs, size, order, groups, "__before").where(F.col("__before") < limit).drop("__before")


def seeded_key(*columns, seed: int) -> Column:
    """A hash that orders rows at random, the same in every run and on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def positional_split(docs: DataFrame, held: float, order: list[str], groups: list[str]) -> DataFrame:
    """``docs`` with ``part``: of each group the first max(1, floor(n * (1 - held))) rows are train, the others held."""
    counts = docs.groupBy(*groups).agg(F.count("*").alias("__n")).select(*(F.col(g).alias(f"__c_{g}") for g in groups), "__n")
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__c_{g}"))
    placed = with_number(docs, order, groups, "__place").join(counts, same)
    part = F.when(F.col("__place") <= F.greatest(F.lit(1), F.floor(F.col("__n") * (1 - held))), "train").otherwise("held")
    return placed.withColumn("part", part).drop("__place", "__n", *(f"__c_{g}" for g in groups))


def heldout_by_shuffle(docs: DataFrame, seed: int) -> DataFrame:
    """Held-out documents made by shuffling words: not of code, math and markdown, at least 3 words. (doc_id, kind, text)"""
    base = docs.where("doc_id is not null and text is not null and (kind is null or kind not in ('code', 'math', 'markdown'))").withColumn("w", words(F.col("text"))).where("size(w) >= 3")
    keyed = F.transform("w", lambda x, k: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), k.cast("string"))).alias("key"), k.alias("k"), x.alias("w")))
    base = base.withColumn("shuffled", F.array_join(F.transform(F.sort_array(keyed), lambda s: s["w"]), " "))
    return base.select(F.concat(F.lit("held-"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.coalesce("kind", F.lit("")), F.lit("_held")).alias("kind"), F.col("shuffled").alias("text"))


def sentences(docs: DataFrame) -> DataFrame:
    """One row per piece between dandas."""
    return docs.where("text is not null").select(F.explode(F.split("text", "।", -1)).alias("sentence"))


def sentence_overlap(train: DataFrame, held: DataFrame) -> DataFrame:
    """(sentences, hits, overlap): the held sentences, each as often as it occurs, that the other side has too."""
    known = sentences(train).distinct().withColumn("hit", F.lit(1))
    counts = sentences(held).groupBy("sentence").agg(F.count("*").alias("n"))
    return counts.join(known, "sentence", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits")).withColumn("overlap", F.when(F.col("sentences") > 0, F.col("hits") / F.col("sentences")).otherwise(0.0))


def extract(docs: DataFrame, least: int, most: int) -> DataFrame:
    """Texts trimmed, with at least ``least`` characters, cut at ``most``."""
    return docs.withColumn("text", strip(F.col("text"))).where(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))


def joined_sample(docs: DataFrame, order: list[str], groups: list[str], lines: int, chars: int) -> DataFrame:
    """(groups, lines, text): of each group the first texts, at most ``lines`` and until they have ``chars`` characters (with the
    one that reaches them), joined by line feeds. So a group's text is bounded, whatever its rows."""
    sized = docs.select(*groups, *order, "text", F.length("text").alias("__n"))
    cut = running_cut(sized, F.col("__n"), chars, order, groups)
    cut = with_number(cut, order, groups, "__k").where(F.col("__k") <= lines)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("__k", "text"))), lambda r: r["text"])
    return cut.groupBy(*groups).agg(F.count("*").alias("lines"), F.array_join(rows, "\n").alias("text"))


def extract_lines(lines: DataFrame, skip: int, least: int, most: int, target: int, key: str = "text") -> tuple[DataFrame, DataFrame]:
    """((line_no, text), counters) of lines (line_no from 1 on, line): the string ``key`` of the JSON objects behind the first
    ``skip`` lines, trimmed, with at least ``least`` characters, cut at ``most``, until ``target`` characters are there.

    Counters: read (lines behind the skipped ones), broken (no JSON), without (no such string), short, taken, chars.
    Broken, without and short count all lines that were read.
    """
    parsed = F.try_parse_json("line")
    own = strip(F.try_variant_get(parsed, f"$.{key}", "string"))
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))
    said = F.when(kind == "STRING", own)
    state = F.when(parsed.isNull(), "broken").when(said.isNull(), "without").when(F.length(said) < least, "short").otherwise("fits")
    each = materialize(lines.where(F.col("line_no") > skip).select("line_no", state.alias("state"), F.substring(said, 1, most).alias("text")), "extract")
    fits = each.where("state = 'fits'").select("line_no", "text")
    taken = materialize(running_cut(fits, F.length("text"), target, ["line_no"]), "taken")
    counts = each.agg(F.count("*").alias("read"), *(F.count_if(F.col("state") == s).alias(s) for s in ("broken", "without", "short")))
    return taken, counts.crossJoin(taken.agg(F.count("*").alias("taken"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))


def group_scan(lines: DataFrame, field: str, most: int) -> DataFrame:
    """(name, first_line, lines) of the values of a JSON field in the first ``most`` lines, found by pattern without parsing."""
    found = F.regexp_extract("line", f'"{field}"\\s*:\\s*"([^"]+)"', 1)
    return lines.where(F.col("line_no") <= most).select("line_no", found.alias("name")).where("name <> ''").groupBy("name").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"))
