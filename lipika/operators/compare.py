"""A slot tokenizer against one vocabulary for all scripts, by the tokens both really need."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scripts import CATCHALL, NEUTRAL, nfc
from ..session import materialize
from . import build, codec, segment
from .prefix import with_before
from .slots import BYTE_ROWS, SPECIALS, SlotSpec

SHARED = "ALL"
SHARED_SPECS = (SlotSpec(SHARED, "unigram", max_piece_length=16), SlotSpec(CATCHALL, "bytes", trained=False, exempt_from_budget=True))


def pure_documents(docs: DataFrame, purity: int = 90) -> DataFrame:
    """(doc_id, slot, text, ...) of documents with at least ``purity`` per cent of their characters besides NEUTRAL in one slot."""
    runs = segment.runs(docs).where(F.col("slot") != NEUTRAL)
    per = runs.groupBy("doc_id", "slot").agg(F.sum(F.length("text")).alias("n"), F.min("run_pos").alias("first"))
    top = per.groupBy("doc_id").agg(F.max_by("slot", F.struct("n", -F.col("first"))).alias("slot"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return docs.where("text is not null").join(top.where(f"100 * n div all >= {purity}").select("doc_id", "slot"), "doc_id")


def balanced(pure: DataFrame) -> DataFrame:
    """Pure documents of each slot, in the order of their ids' md5, until the slot has as many bytes as the smallest has."""
    sized = pure.select("doc_id", "slot", "text", F.md5(F.col("doc_id").cast("string")).alias("order"), F.octet_length("text").alias("bytes"))
    placed = with_before(sized, F.col("bytes"), ["order", "doc_id"], ["slot"])
    least = sized.groupBy("slot").agg(F.sum("bytes").alias("all")).agg(F.min("all").alias("least"))
    return placed.crossJoin(F.broadcast(least)).where("before < least").select("doc_id", "slot", "text")


def train_shared(docs: DataFrame, total: int) -> DataFrame:
    """One unigram vocabulary of at most ``total`` ids for all scripts, with the same specials and bytes."""
    runs = docs.where("text is not null").select(F.lit(SHARED).alias("slot"), nfc(F.col("text")).alias("text"))
    return build.assemble(build.slot_pieces(runs, {SHARED: total - len(SPECIALS) - BYTE_ROWS}, SHARED_SPECS), SHARED_SPECS)[0]


def with_shared_tokens(docs: DataFrame, vocab: DataFrame, text: str = "text", out: str = "base_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text under a shared vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(codec.Vocabulary.load(vocab))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            sizes = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                n = 0
                for part in own.parts(SHARED, t or ""):
                    hit = known.get(part)
                    if hit is None:
                        if len(known) > 200_000:
                            known.clear()
                        hit = known[part] = len(own.encode(SHARED, part))
                    n += hit
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` long"])
    return docs.withColumn("__nfc", nfc(F.col(text))).mapInArrow(count, schema)


def compared(pure: DataFrame, vocab: DataFrame, shared: DataFrame, by: tuple[str, ...] = ("slot",)) -> DataFrame:
    """(*by, documents, chars, part_tokens, base_tokens, improvement_pct, wins): both tokenizers on the same documents."""
    both = with_shared_tokens(codec.encoded_runs(pure, vocab, (*by, "text")).select(*by, "text", F.length("text").alias("chars"), F.size("ids").alias("part")), shared)
    sums = both.groupBy(*by).agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("part").alias("part_tokens"), F.sum("base_tokens").alias("base_tokens"))
    return rated(sums)


def rated(sums: DataFrame) -> DataFrame:
    """``sums`` with improvement_pct, what the parts save of the base's tokens, and wins."""
    saved = F.col("base_tokens") - F.col("part_tokens")
    return sums.withColumn("improvement_pct", F.try_divide(100.0 * saved, F.col("base_tokens"))).withColumn("wins", saved > 0)


def costs(per_slot: DataFrame, part_size: int, base_size: int, width: int = 2048) -> DataFrame:
    """(slot, ..., part_embedding, base_embedding, indic_better, no_regression): the rows of ``compared`` and one over all of
    them (slot ALL), with what the vocabularies cost in embedding parameters and the two gates of a comparison.

    indic_better: DEVANAGARI and KANNADA need fewer tokens, null where neither is there; no_regression: no slot
    needs over one per cent more.
    """
    whole = per_slot.agg(F.lit("ALL").alias("slot"), *(F.sum(c).alias(c) for c in ("documents", "chars", "part_tokens", "base_tokens")))
    saved = F.col("base_tokens") - F.col("part_tokens")
    whole = whole.withColumn("improvement_pct", F.try_divide(100.0 * saved, F.col("base_tokens"))).withColumn("wins", saved > 0).where("documents is not null")
    gates = per_slot.agg(F.bool_and(F.when(F.col("slot").isin("DEVANAGARI", "KANNADA"), F.col("wins"))).alias("indic_better"), F.bool_and(F.coalesce("improvement_pct", F.lit(0.0)) >= -1.0).alias("no_regression"))
    rows = per_slot.select(*whole.columns).unionByName(whole)
    rates = [F.try_divide(F.col(f"{k}_tokens").cast("double"), F.col("chars")).alias(f"{k}_tokens_per_char") for k in ("part", "base")]
    return rows.select("*", *rates, F.lit(part_size * width).alias("part_embedding"), F.lit(base_size * width).alias("base_embedding")).crossJoin(F.broadcast(gates))


def by_algorithm(docs: DataFrame, size: int, slots_: tuple[str, ...] = ("LATIN", "DEVANAGARI", "KANNADA"), held: float = 0.15) -> DataFrame:
    """(slot, mode, bpe, unigram, winner, margin_pct): tokens of held-out runs under both algorithms at the same size, for both
    white space modes. Documents are held out by a hash of their id."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    found = None
    for mode in ("leading", "neutral"):
        runs = materialize(segment.runs(docs, mode=mode).where(F.col("slot").isin(list(slots_))).withColumn("held", key < held).select("slot", "text", "held"), "runs")
        for algorithm in ("bpe", "unigram"):
            specs = tuple(SlotSpec(s, algorithm) for s in slots_)
            pieces, merges = build.train_slots(runs.where("not held"), dict.fromkeys(slots_, size), specs)
            numbered = pieces.orderBy("slot", "token").collect()  # bounded by the sizes
            rows = [(k, r["slot"], r["token"], r["score"]) for k, r in enumerate(numbered)] + [(len(numbered) + b, CATCHALL, f"<0x{b:02X}>", None) for b in range(BYTE_ROWS)]
            vocab = docs.sparkSession.createDataFrame(rows, "id int, slot string, token string, score double")
            one = tokens_by_slot(runs.where("held"), vocab, merges).select("slot", F.lit(mode).alias("mode"), F.lit(algorithm).alias("algorithm"), "tokens")
            found = one if found is None else found.unionByName(one)
    return winners(found)


def winners(scores: DataFrame, first: str = "bpe", second: str = "unigram") -> DataFrame:
    """(slot, mode, first, second, winner, margin_pct) of (slot, mode, algorithm, tokens): who needs fewer, and by how much of the
    other's; a tie has no winner."""
    wide = scores.groupBy("slot", "mode").pivot("algorithm", [first, second]).agg(F.sum("tokens"))
    winner = F.when(F.col(first) < F.col(second), first).when(F.col(second) < F.col(first), second)
    margin = 100.0 * (F.greatest(first, second) - F.least(first, second)) / F.greatest(first, second)
    return wide.select("slot", "mode", first, second, winner.alias("winner"), margin.alias("margin_pct"))


def tokens_by_slot(runs: DataFrame, vocab: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(slot, tokens) of runs (slot, text), each distinct run encoded once."""
    folded = runs.groupBy("slot", "text").agg(F.count("*").alias("n"))
    return codec.encoded_rows(folded, vocab, merges).groupBy("slot").agg(F.sum(F.col("n") * F.size("ids")).alias("tokens"))


def gap(pure: DataFrame, vocab: DataFrame, shared: DataFrame) -> DataFrame:
    """(slot, train, held, gap): the improvement on training and on other documents (``held`` tells), in per cent, and the difference."""
    return gaps(compared(pure, vocab, shared, ("slot", "held")))


def gaps(rows: DataFrame) -> DataFrame:
    """(slot, train, held, gap) of rows by slot and held."""
    side = {n: F.max(F.when(F.col("held") == F.lit(v), F.col("improvement_pct"))).alias(n) for n, v in (("train", False), ("held", True))}
    return rows.groupBy("slot").agg(*side.values()).withColumn("gap", F.col("train") - F.col("held"))


def gain_by_size(docs: DataFrame, totals: tuple[int, ...], scored: DataFrame | None = None) -> DataFrame:
    """(slot, total, chars, tokens, fertility, gain_pct): tokens per character of ``scored`` (or ``docs``) under vocabularies
    trained on ``docs`` at each total, and what each total saves over the one before."""
    per = None
    for total in totals:
        built = build.train(docs, total, least=min(300, total // 10))
        found = codec.encoded_runs(docs if scored is None else scored, built.vocab, merges=built.merges)
        stats = found.select(F.inline("run_stats")).groupBy("slot").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
        one = materialize(stats.select("slot", F.lit(total).alias("total"), "chars", "tokens"), "gain")
        per = one if per is None else per.unionByName(one)
    return gains(per, "slot")


def gains(sizes: DataFrame, by: str) -> DataFrame:
    """``sizes`` (by, total, tokens, chars) with fertility and the share, in per cent, a total saves over the one before."""
    before = F.lag("fertility").over(Window.partitionBy(by).orderBy("total"))
    return sizes.withColumn("fertility", F.col("tokens") / F.col("chars")).withColumn("gain_pct", (before - F.col("fertility")) / before * 100)


def utilization(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(slot, size, used, utilization): the ids of each slot that the documents' tokens use."""
    used = codec.encoded_runs(docs, vocab).select(F.explode("ids").alias("id")).distinct().withColumn("hit", F.lit(1))
    found = vocab.where("slot is not null").select("id", "slot").join(used, "id", "left")
    return found.groupBy("slot").agg(F.count("*").alias("size"), F.count("hit").alias("used")).withColumn("utilization", F.col("used") / F.col("size"))
