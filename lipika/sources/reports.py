"""Reports of a tokenizer on documents: rows by language, JSON and a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import nfc
from ..functions.text import ratio, word_count
from ..model import TokenizerModel

COLUMNS = ("language", "documents", "words", "chars", "bytes", "tokens", "as_bytes", "tokens_per_word", "bytes_per_token", "chars_per_token", "exact")


def benchmark_rows(docs: DataFrame, model: TokenizerModel, by: str) -> DataFrame:
    """One row per language (column ``by``): sizes, tokens, how many of them are bytes, ratios, and whether every text came back
    exactly (compared in composed form)."""
    given = docs.where("text is not null").select(F.col(by).alias("language"), nfc(F.col("text")).alias("text"))
    encoded = model.decode(model.encode(given, ("language", "text"), "text"))
    raw = F.aggregate("run_stats", F.lit(0), lambda a, r: a + r["as_bytes"])
    t = F.col("text")
    sums = encoded.groupBy("language").agg(F.count("*").alias("documents"), F.sum(word_count(t)).alias("words"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(F.size("ids")).alias("tokens"), F.sum(raw).alias("as_bytes"), F.bool_and(F.col("decoded") == t).alias("exact"))
    rates = [ratio(F.col(a), F.col(b)).alias(f"{a}_per_{b[:-1]}") for a, b in (("tokens", "words"), ("bytes", "tokens"), ("chars", "tokens"))]
    return sums.select("*", *rates).select(*COLUMNS)


def benchmark(rows: DataFrame, seconds: float) -> dict:
    """Rows (a few) and totals as plain values; ``seconds`` is what encoding took."""
    each = [{k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in rows.orderBy("language").collect()]
    tokens, size = (sum(r[c] for r in each) for c in ("tokens", "bytes"))
    return {"languages": each, "tokens": tokens, "bytes": size, "seconds": round(seconds, 4), "tokens_per_second": round(tokens / seconds, 1), "kib_per_second": round(size / 1024 / seconds, 1), "exact": all(r["exact"] for r in each)}


def benchmark_table(said: dict) -> str:
    """A benchmark as a Markdown table."""
    lines = ["| " + " | ".join(COLUMNS) + " |", "|" + " --- |" * len(COLUMNS)]
    lines += ["| " + " | ".join(str(r[c]) for c in COLUMNS) + " |" for r in said["languages"]]
    return "\n".join([*lines, "", f"{said['tokens']} tokens in {said['seconds']} s: {said['tokens_per_second']} tokens a second, {said['kib_per_second']} KiB a second", ""])
