"""Problem 6: documents into containers of fixed capacity, by minimum bin slack.

Items meet in windows of bounded size, chosen by hash. A window is packed container by container: the longest
item left goes in, and a subset-sum bitset over the multiset of lengths left finds what fills the rest best;
backtracking through the bitsets says how many items of each length that takes. A document larger than a
container fills containers of its own; only what is left over of it is an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few, materialize
from .tokens import DEFAULT, with_tokens

WINDOW = 20_000  # items that are packed together, about
PACKS = 10_000  # kinds of containers; more are an error


def best_fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length fill ``room`` best. ``lengths`` are the ones left, longest first."""
    mask, target = (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []  # (length, items, sums reachable before)
    sums = 1
    for length in lengths:
        if length > room:
            continue
        left, piece = min(counts[length], room // length), 1
        while left > 0:
            take = min(piece, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            piece *= 2
        if sums & target:
            break
    at = sums.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + take
            at -= length * take
    return taken


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0 on, of each item; items are at most as long as a container. Items of size 0 go to the first."""
    order = np.argsort(-sizes, kind="stable")
    values, firsts, numbers = np.unique(-sizes[order], return_index=True, return_counts=True)
    queues = {int(-v): order[f : f + n] for v, f, n in zip(values, firsts, numbers)}  # by length, longest first
    counts = {length: len(q) for length, q in queues.items() if length > 0}
    out = np.zeros(len(sizes), np.int64)
    lengths, box = list(counts), 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        taken = best_fill(capacity - longest, lengths, counts)
        taken[longest] = taken.get(longest, 0) + 1
        counts[longest] += 1
        for length, n in taken.items():
            have = counts[length]
            out[queues[length][have - n : have]] = box
            counts[length] = have - n
        if any(counts[length] == 0 for length in taken):
            lengths = [x for x in lengths if counts[x]]
        box += 1
    return out


def _packed(table: pa.Table) -> pa.Table:
    capacity, window = table["capacity_tokens"][0].as_py(), table["window"][0].as_py()
    table = table.sort_by("doc_id")
    sizes = table["tokens"].to_numpy()
    boxes = pack(sizes, capacity) if len(sizes) else np.zeros(0, np.int64)
    return pa.table({"pack_name": table["pack_name"], "capacity_tokens": table["capacity_tokens"], "doc_id": table["doc_id"], "piece": table["piece"], "tokens": table["tokens"], "container": pa.array((np.int64(window) << 32) + boxes)})


def placements(docs: DataFrame, capacities: DataFrame, path: str = DEFAULT, window: int = WINDOW) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, piece, tokens, container): where each document, or each piece of one that is
    larger than a container, is.

    Container numbers are unique within a pack. Null and empty texts have no tokens and take no space, but a place.
    Rows that repeat a doc_id are items of their own. Capacities that are null or below 1 are left out; more than PACKS kinds of
    containers are an error.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sizes = materialize(with_tokens(docs.where("doc_id is not null").select("doc_id", "text"), path), "sizes")
    windows = max(1, round(sizes.count() / window))
    packs = capacities.where("capacity_tokens >= 1 and pack_name is not null").select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    kinds = docs.sparkSession.createDataFrame(few(packs, PACKS, "kinds of containers"), packs.schema)
    each = sizes.crossJoin(F.broadcast(kinds))  # a bounded table of container kinds, not of records
    whole = F.expr("cast(tokens div capacity_tokens as int)")
    each = each.withColumn("whole", F.when(F.col("tokens") > F.col("capacity_tokens"), whole).otherwise(0))
    large = each.where("whole > 0").select("pack_name", "capacity_tokens", "doc_id", F.explode(F.expr("sequence(0, whole - 1)")).alias("piece"), F.col("capacity_tokens").cast("long").alias("tokens"))
    # a container of its own for each whole piece: negative numbers, unique by document and piece
    own = large.withColumn("container", -1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit((1 << 62) - 1)))
    items = each.select("pack_name", "capacity_tokens", "doc_id", F.col("whole").alias("piece"), (F.col("tokens") - F.col("whole") * F.col("capacity_tokens")).alias("tokens"), "whole")
    items = items.where("tokens > 0 or whole = 0").drop("whole").withColumn("window", F.pmod(F.xxhash64("doc_id"), F.lit(windows)))
    schema = f"pack_name string, capacity_tokens int, doc_id {kind}, piece int, tokens long, container long"
    packed = items.groupBy("pack_name", "window").applyInArrow(_packed, schema)
    return packed.unionByName(own)


def fill(placed: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, pieces, tokens, containers, least_containers, fill): how full the containers are. Fill is
    the share of their capacity in use; least_containers is what the tokens need if nothing were lost."""
    boxes = placed.groupBy("pack_name", "capacity_tokens", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    sums = boxes.groupBy("pack_name", "capacity_tokens").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"))
    return sums.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
