"""Problem 7: a mix of sources with target shares of the tokens.

Each document has a hash-random key. Sources are range-sorted by it: the key's first bits name its range, as many
ranges as keep them small in any hot source, and a range is sorted inside. Sums of ranges, added up, give each
range its start and so each document its exact place in its source. A mix has the total asked for, or as many
tokens as its scarcest source allows with the repeats it may have; each source is cut where its budget ends, after
as many whole rounds as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import DEFAULT, entry_form, with_tokens

SLICE = 20_000  # documents of a source in one range, about
SEED = 20240607


def places(docs: DataFrame, path: str = DEFAULT, seed: int = SEED) -> DataFrame:
    """(source, doc_id, tokens, until): documents in random order with the tokens of their source up to and with them."""
    given = docs.where("doc_id is not null and source is not null").select("doc_id", entry_form(F.col("source")).alias("source"), "text")
    sizes = materialize(with_tokens(given, path).where("tokens > 0").withColumn("key", F.xxhash64("doc_id", F.lit(seed))), "mix-sizes")
    bits = max(6, (sizes.count() // SLICE).bit_length())
    sliced = sizes.withColumn("slice", F.shiftrightunsigned("key", 64 - bits))  # ranges of the unsigned key
    sums = sliced.groupBy("source", "slice").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("start", F.sum("sum").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.withColumn("own", F.sum("tokens").over(inside)).join(before, ["source", "slice"]).select("source", "doc_id", "tokens", (F.col("own") + F.col("start")).alias("until"))


def budgets(placed: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, available, goal, budget): the tokens each source has to give.

    goal is the target share among the sources of the mix that have documents; a source without has budget 0. With
    ``total`` a mix asks for that many tokens, of each source at most all its documents with all repeats (what is short
    shows in the shares reached); without, every source can give its goal.
    Repeated targets of a source add up, with the least of their repeats; shares that are null or not positive are left out.
    """
    wanted = targets.where("mix_name is not null and source is not null and target_share > 0").groupBy("mix_name", entry_form(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    have = placed.groupBy("source").agg(F.sum("tokens").alias("available"))
    both = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    goal = F.when(F.col("available") > 0, F.col("target_share"))
    both = both.withColumn("goal", F.coalesce(goal / F.sum(goal).over(mix), F.lit(0.0)))
    most = F.col("max_repeats") * F.col("available")
    size = F.lit(total) if total else F.min(F.when(F.col("available") > 0, most / F.col("goal"))).over(mix)
    return both.withColumn("budget", F.least(most, F.coalesce(F.floor(F.col("goal") * size + 1e-6), F.lit(0)).cast("long")))


def selection(placed: DataFrame, budget: DataFrame) -> DataFrame:
    """(mix_name, source, doc_id, tokens, repeats): the documents of each mix and how often each is used.

    In the last round a document is in as long as at least half of it lies within the budget.
    """
    rounds = budget.where("budget > 0").select("mix_name", "source", F.expr("budget div available").alias("rounds"), F.expr("budget % available").alias("rest"))
    chosen = placed.join(F.broadcast(rounds) if rounds.limit(100_001).count() <= 100_000 else rounds, "source")
    last = (2 * F.col("until") - F.col("tokens") <= 2 * F.col("rest")).cast("int")
    return chosen.withColumn("repeats", (F.col("rounds") + last).cast("int")).where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")


def mixed(docs: DataFrame, targets: DataFrame, path: str = DEFAULT, seed: int = SEED, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of each mix. Null or empty texts and documents without id or source are in none; rows that repeat a
    doc_id are documents of their own; extra columns are ignored. shares has one row per target with the share reached."""
    placed = materialize(places(docs, path, seed), "mix-places")
    budget = materialize(budgets(placed, targets, total), "mix-budgets")
    chosen = selection(placed, budget)
    given = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    shares = budget.join(given, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", "goal", "max_repeats", "available", "budget", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_repeats")))
    shares = shares.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)))
    return chosen, shares
