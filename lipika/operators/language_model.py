"""Bits per byte of token streams under a smoothed bigram model, compared over seeds.

A token's probability is that of its pair with the one before, backed off to its own: both are counts, so a model is
two aggregates and scoring is a join with them. Seeds decide by a hash which documents a model is fitted on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BACK_OFF = 5.0  # pairs a token's own frequency counts as


def held_out(docs: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``held``: about half of them, by a hash of seed and key."""
    return docs.withColumn("held", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) < "8")


def pair_counts(streams: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """(held, a, b, n) of streams (key, ids): how often a token follows another, by side. A stream's first token is not scored."""
    pairs = F.expr("transform(sequence(1, size(ids) - 1), i -> struct(ids[i - 1] as a, ids[i] as b))")
    return held_out(streams.where("size(ids) >= 2"), seed, key).select("held", F.inline(pairs)).groupBy("held", "a", "b").agg(F.count("*").alias("n"))


def score(counts: DataFrame, vocabulary: int, order: int = 2) -> DataFrame:
    """(tokens, nll): what the held-out side costs in nats under the model of the other side; of order 1 or 2."""
    fit = counts.where("not held")
    own = fit.groupBy("b").agg(F.sum("n").alias("own"))
    whole = fit.agg(F.sum("n").alias("whole"))
    alone = (F.coalesce("own", F.lit(0)) + 1) / (F.coalesce("whole", F.lit(0)) + vocabulary)
    scored = counts.where("held").join(own, "b", "left").crossJoin(F.broadcast(whole))
    if order == 2:
        first = fit.groupBy("a").agg(F.sum("n").alias("first"))
        scored = scored.join(fit.select("a", "b", F.col("n").alias("both")), ["a", "b"], "left").join(first, "a", "left")
        alone = (F.coalesce("both", F.lit(0)) + BACK_OFF * alone) / (F.coalesce("first", F.lit(0)) + BACK_OFF)
    return scored.agg(F.sum("n").alias("tokens"), F.sum(-F.log(alone) * F.col("n")).alias("nll"))


def held_bytes(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    return held_out(docs, seed, key).where("held").agg(F.sum(F.octet_length(text)).alias("bytes"))


def by_seed(first: tuple[DataFrame, int, int], second: tuple[DataFrame, int, int], docs: DataFrame, seeds: int = 3) -> DataFrame:
    """(seed, part_bpb, part_perplexity, base_bpb, base_perplexity, delta) of two (streams, vocabulary size, order) over the
    same documents; delta is what the first saves."""
    found = None
    for seed in range(1, seeds + 1):
        one = held_bytes(docs, seed).select(F.lit(seed).alias("seed"), "bytes")
        for name, (streams, size, order) in (("part", first), ("base", second)):
            cost = score(materialize(pair_counts(streams, seed), "pairs"), size, order)
            one = one.crossJoin(cost.select((F.col("nll") / F.log(F.lit(2.0))).alias(f"{name}_bits"), F.exp(F.col("nll") / F.col("tokens")).alias(f"{name}_perplexity")))
        found = one if found is None else found.unionByName(one)
    rates = [(F.col(f"{k}_bits") / F.col("bytes")).alias(f"{k}_bpb") for k in ("part", "base")]
    return found.select("seed", *rates, "part_perplexity", "base_perplexity").withColumn("delta", F.col("base_bpb") - F.col("part_bpb"))


def summary(rows: DataFrame) -> DataFrame:
    """(seeds, part_bpb, base_bpb, delta, spread, decisive, winner): means over seeds; a difference decides if it is larger than
    its spread (the sample deviation, 0 for one seed)."""
    spread = F.coalesce(F.stddev_samp("delta"), F.lit(0.0))
    means = rows.agg(F.count("*").alias("seeds"), F.avg("part_bpb").alias("part_bpb"), F.avg("base_bpb").alias("base_bpb"), F.avg("delta").alias("delta"), spread.alias("spread"))
    decisive = F.abs("delta") > F.col("spread")
    winner = F.when(decisive & (F.col("delta") > 0), "part").when(decisive & (F.col("delta") < 0), "base").otherwise("inconclusive")
    return means.withColumn("decisive", decisive).withColumn("winner", winner)


def compare(part: DataFrame, base: DataFrame, docs: DataFrame, part_size: int, base_size: int, seeds: int = 3) -> DataFrame:
    """The summary of two tokenizations (doc_id, ids) of the same documents."""
    streams = [materialize(x, "streams") for x in (part, base)]
    return summary(by_seed((streams[0], part_size, 2), (streams[1], base_size, 2), docs, seeds))


def parameters(vocabulary: int, width: int, layers: int, length: int, inner: int = 4) -> int:
    """Parameters of a decoder-only transformer with tied embeddings and biases: tokens and positions, then for each layer
    attention, two dense layers and two norms, and a last norm."""
    dense = width * inner * width
    layer = 4 * width * width + 4 * width + 2 * dense + inner * width + width + 4 * width
    return vocabulary * width + length * width + layers * layer + 2 * width


def windows(streams: DataFrame, length: int, most: int, seed: int, key: str = "doc_id") -> DataFrame:
    """(key, start): ``most`` windows of ``length`` + 1 tokens at starts chosen by a hash, for training by samples."""
    starts = streams.where(F.size("ids") > length).select(key, F.explode(F.sequence(F.lit(0), F.size("ids") - length - 1)).alias("start"))
    return starts.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("start").cast("string")))).limit(most)
