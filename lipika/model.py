"""A frozen tokenizer as one object: columns in, columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import build, codec, segment, slots
from .operators.slots import SlotSpec
from .sources import sinks


class TokenizerModel:
    """Vocabulary, layout, merges and specifications, with the operators that need them."""

    def __init__(self, vocab: DataFrame, ranges: DataFrame, mode: str = "leading", merges: DataFrame | None = None, specs: Sequence[SlotSpec] = slots.DEFAULT_SPECS) -> None:
        self.vocab, self.ranges, self.mode, self.merges, self.specs = vocab, ranges, mode, merges, specs

    @classmethod
    def load(cls, spark: SparkSession, path: str, mode: str = "leading") -> TokenizerModel:
        """A frozen artifact; a layout or specifications that are not sound are an error."""
        ranges, _, _ = slots.layout_from_json(spark, sinks.frozen_text(spark, path, "layout.json"))
        specs = slots.specs_from_config(sinks.frozen_text(spark, path, "slots.json"))
        return cls(spark.read.parquet(f"{path}/vocab"), ranges, mode, spark.read.schema(sinks.MERGES).parquet(f"{path}/merges"), specs)

    @classmethod
    def of(cls, built: build.Built, mode: str = "leading") -> TokenizerModel:
        return cls(built.vocab, built.ranges, mode, built.merges, built.specs)

    def save(self, path: str) -> DataFrame:
        """Freeze into a folder; returns the manifest."""
        return sinks.freeze(self.vocab, self.ranges, path, self.specs, self.merges)

    def runs(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
        return segment.runs(docs, keys, text, self.mode, slot_map=slots.slot_map(self.specs))

    def encode(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", mark: int | None = None) -> DataFrame:
        """The keys with ``ids`` and ``run_stats``; with ``mark`` that id between runs of different slots."""
        return codec.encoded_runs(docs, self.vocab, keys, text, self.mode, self.merges, mark)

    def encode_runs(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
        """One row per run: the keys, run_pos, slot and the run's ids."""
        return codec.encoded_rows(self.runs(docs, keys, text).select(*keys, "run_pos", "slot", "text"), self.vocab, self.merges)

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "decoded", specials: bool = False) -> DataFrame:
        return codec.decoded(encoded, self.vocab, ids, out, specials)

    def slot_of_id(self, ids: DataFrame, column: str = "id") -> DataFrame:
        return slots.with_slot_of_id(ids, self.ranges, column)

    def tokens_of_ids(self, ids: DataFrame, column: str = "id", unknown: str = "<unk>") -> DataFrame:
        """``ids`` with ``token``; ids outside the vocabulary get ``unknown``."""
        return with_tokens(ids, self.vocab, column, unknown)

    def ids_of_tokens(self) -> DataFrame:
        """(token, id): the vocabulary by token; of tokens that occur in several slots the first id."""
        return self.vocab.groupBy("token").agg(F.min("id").alias("id"))

    def describe(self) -> DataFrame:
        rows = [(s.name, list(s.scripts), s.structural, s.trained) for s in self.specs]
        return self.ranges.join(self.ranges.sparkSession.createDataFrame(rows, "name string, scripts array<string>, structural boolean, trained boolean"), "name", "left")

    def vocab_size(self) -> int:
        return self.ranges.agg(F.max("end_id")).first()[0]


def with_tokens(ids: DataFrame, vocab: DataFrame, column: str = "id", unknown: str = "<unk>") -> DataFrame:
    named = vocab.select(F.col("id").alias("__id"), "token")
    return ids.join(named, F.col(column) == F.col("__id"), "left").drop("__id").withColumn("token", F.coalesce("token", F.lit(unknown)))


def framed(ids: Column, bos: int = 1, eos: int = 2) -> Column:
    """Ids between the marks of begin and end."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def without_specials(ids: Column, specials: int = len(slots.SPECIALS)) -> Column:
    return F.filter(ids, lambda x: x >= specials)


def padded_batches(encoded: DataFrame, batch: list[str], ids: str = "ids", pad: int = 0) -> DataFrame:
    """``encoded`` with ids padded to the longest of the batch and an attention mask of the same length."""
    width = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    wide = encoded.withColumn("__n", F.size(ids)).withColumn("__w", width)
    mask = F.concat(F.array_repeat(F.lit(1), F.col("__n")), F.array_repeat(F.lit(0), F.col("__w") - F.col("__n")))
    filled = F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("__w") - F.col("__n")))
    return wide.withColumn("attention_mask", mask).withColumn(ids, filled).drop("__n", "__w")
