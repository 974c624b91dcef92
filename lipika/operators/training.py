"""Training subword models of all slots at once: byte-pair merges and unigram pieces.

Corpora are folded to distinct runs with counts, which stay distributed. A round is one job over them with the
models of all slots broadcast; what comes back are the best pairs or the expected uses of the pieces, bounded by the
budgets. No task holds a slot. Ties break by the pieces themselves, so the same counts give the same models.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_runs import flat, points_of
from ..session import materialize

MERGED = 0x110000  # symbols from here on are merges, below code points or bytes
SHARE = 0.3  # merges of a round have at least this share of the count of its best one
ASKED = 2048  # pairs of a slot that come back from a round
ROUNDS_WRITTEN = 12  # rounds after which the merged runs are written out
BASE = 0x9E3779B97F4A7C15


def run_counts(runs: DataFrame) -> DataFrame:
    """(slot, text, n): the distinct runs of each slot."""
    return runs.groupBy("slot", "text").agg(F.count("*").alias("n"))


def first_pairs(counts: DataFrame) -> DataFrame:
    """(slot, first, second, n): how often two UTF-8 bytes are next to each other in the runs, weighted by run counts."""
    from ..functions.text import utf8_bytes

    pairs = F.expr("transform(sequence(1, size(b) - 1), i -> struct(b[i - 1] as first, b[i] as second))")
    return counts.withColumn("b", utf8_bytes(F.col("text"))).where("size(b) >= 2").select("slot", "n", F.inline(pairs)).groupBy("slot", "first", "second").agg(F.sum("n").alias("n"))


# --- byte-pair merges ------------------------------------------------------------------------------------------
def apply_merges(symbols: np.ndarray, row: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their rows after one round of merges (left, right, new), see Merges.accept."""
    to = {(a, b): c for a, b, c in merges}
    keys = np.array(sorted(a << 32 | b for a, b in to), np.int64)
    new = np.array([to[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in keys], np.int64)
    pair = symbols[:-1] << 32 | symbols[1:]
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    hit = np.flatnonzero((keys[at] == pair) & (row[:-1] == row[1:]))
    if not len(hit):
        return symbols, row
    # of equal symbols in a row the first two merge, then the next two
    first = np.ones(len(hit), bool)
    first[1:] = hit[1:] != hit[:-1] + 1
    place = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
    hit = hit[place % 2 == 0]
    out = symbols.copy()
    out[hit] = new[at[hit]]
    keep = np.ones(len(symbols), bool)
    keep[hit + 1] = False
    return out[keep], row[keep]


def _merged(batches: Iterator[pa.RecordBatch], rounds: Mapping[str, list]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, symbols, rows, counts) of each slot in each batch, with the rounds of merges applied."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for slot in sorted(set(names)):
            own = batch.filter(pa.array([x == slot for x in names]))
            lists = own.column(1)
            symbols, off = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(own)), np.diff(off))
            for merges in rounds.get(slot, ()):
                if len(symbols) > 1 and merges:
                    symbols, row = apply_merges(symbols, row, merges)
            yield slot, symbols, row, own.column(2).to_numpy()


def _pairs(batches: Iterator[pa.RecordBatch], rounds) -> Iterator[pa.RecordBatch]:
    for slot, symbols, row, n in _merged(batches, rounds.value):
        inside = row[:-1] == row[1:]
        pair, weight = (symbols[:-1] << 32 | symbols[1:])[inside], n[row[:-1][inside]]
        found, at = np.unique(pair, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array([slot] * len(found), pa.string()), pa.array(found), pa.array(np.bincount(at, weight, len(found)).astype(np.int64))], names=["slot", "pair", "n"])


def _rewritten(batches: Iterator[pa.RecordBatch], rounds) -> Iterator[pa.RecordBatch]:
    for slot, symbols, row, n in _merged(batches, rounds.value):
        ends = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([slot] * len(n), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(symbols.astype(np.int32))), pa.array(n)], names=["slot", "symbols", "n"])


@dataclass
class Merges:
    """What is known of a slot's merges on the driver; a piece is a text or bytes."""

    size: int  # pieces wanted, with those to begin with
    longest: int
    pieces: dict = field(default_factory=dict)  # symbol -> piece
    found: list[tuple] = field(default_factory=list)  # (left, right, count) as pieces, in order
    done: bool = False

    def accept(self, pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The merges of a round out of (left, right, count), best first. No symbol is on the left of one and on the right of
        another, so no two of them can meet in a text and none changes the count of another."""
        out, lefts, rights, made = [], set(), set(), set(self.pieces.values())
        for a, b, n in pairs:
            if n < 2 or n < SHARE * pairs[0][2] or len(made) >= self.size:
                break
            if a in rights or b in lefts or a == b and (a in lefts or b in rights) or len(self.pieces[a]) + len(self.pieces[b]) > self.longest:
                continue
            lefts.add(a)
            rights.add(b)
            new = MERGED + len(self.found)
            self.found.append((self.pieces[a], self.pieces[b], n))
            self.pieces[new] = self.pieces[a] + self.pieces[b]
            made.add(self.pieces[new])
            out.append((a, b, new))
        self.done = not out or len(made) >= self.size
        return out


def bpe(counts: DataFrame, plans: Mapping[str, Merges], as_bytes: bool = False) -> Mapping[str, Merges]:
    """``plans`` filled with merges. A round takes the most frequent pair and those with at least SHARE of its count that
    no better one can touch, so their counts are what they would be one after the other."""
    spark = counts.sparkSession
    wanted = F.col("slot").isin(list(plans))
    if as_bytes:
        from ..functions.text import utf8_bytes

        symbols = utf8_bytes(F.col("text"))
    else:
        symbols = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    state = materialize(counts.where(wanted & (F.length("text") > 0)).select("slot", symbols.cast("array<int>").alias("symbols"), F.col("n").cast("long")), "symbols")
    for r in state.groupBy("slot").agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct("symbols")))).alias("all")).collect() if not as_bytes else []:
        plans[r["slot"]].pieces |= {s: chr(s) for s in r["all"]}
    for plan in plans.values():
        if as_bytes:
            plan.pieces |= {b: bytes([b]) for b in range(256)}
    rounds: dict[str, list] = defaultdict(list)
    best = Window.partitionBy("slot").orderBy(F.desc("n"), "pair")
    k = 0
    while not all(p.done for p in plans.values()):
        shared = spark.sparkContext.broadcast({s: r for s, r in rounds.items() if not plans[s].done})
        open_slots = state.where(F.col("slot").isin([s for s, p in plans.items() if not p.done]))
        sums = open_slots.mapInArrow(lambda it, shared=shared: _pairs(it, shared), "slot string, pair long, n long").groupBy("slot", "pair").agg(F.sum("n").alias("n"))
        top = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ASKED).collect()
        asked = defaultdict(list)
        for r in sorted(top, key=lambda r: (r["slot"], r["rank"])):
            asked[r["slot"]].append((r["pair"] >> 32, r["pair"] & 0xFFFFFFFF, r["n"]))
        for slot, plan in plans.items():
            if not plan.done:
                rounds[slot].append(plan.accept(asked[slot]) if asked[slot] else [])
                plan.done |= not asked[slot]
        k += 1
        if k % ROUNDS_WRITTEN == 0:
            shared = spark.sparkContext.broadcast(dict(rounds))
            state = materialize(state.mapInArrow(lambda it, shared=shared: _rewritten(it, shared), "slot string, symbols array<int>, n long"), "symbols")
            rounds.clear()
    return plans


def train_bpe(counts: DataFrame, merges: int, longest: int = 1 << 20) -> DataFrame:
    """(slot, rank, left, right, n): merges of the UTF-8 bytes of each slot; pieces as hexadecimal bytes."""
    slots = [r["slot"] for r in counts.select("slot").distinct().collect()]  # at most as many as a layout has
    plans = bpe(counts, {s: Merges(256 + merges, longest) for s in slots}, as_bytes=True)
    rows = [(s, k, a.hex(), b.hex(), n) for s, p in plans.items() for k, (a, b, n) in enumerate(p.found)]
    return counts.sparkSession.createDataFrame(rows, "slot string, rank int, left string, right string, n long")


# --- unigram pieces --------------------------------------------------------------------------------------------
def seed_pieces(counts: DataFrame, longest: int) -> DataFrame:
    """(slot, piece, n): how often each piece of up to ``longest`` characters occurs in the runs."""
    spans = F.expr(f"flatten(transform(sequence(1, length(text)), i -> transform(sequence(1, least({longest}, length(text) - i + 1)), k -> substring(text, i, k))))")
    return counts.where("length(text) > 0").select("slot", "n", F.explode(spans).alias("piece")).groupBy("slot", "piece").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class SpanHashes:
    """Hashes of any spans of an array of code points, the same wherever a span stands."""

    def __init__(self, points: np.ndarray) -> None:
        up, self.down = _powers(len(points))
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(BASE)) * up[:-1], out=self.total[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mixed((self.total[start + size] - self.total[start]) * self.down[start] + np.uint64(size))


class Pieces:
    """The pieces of a slot for lookups by hash."""

    def __init__(self, pieces: list[str], score: np.ndarray) -> None:
        column = pa.array(pieces, pa.string())
        points, sizes = points_of(flat(column)[0]), np.array([len(p) for p in pieces], np.int64)
        off = np.cumsum(sizes) - sizes
        hashes = SpanHashes(points)
        keys = np.zeros(len(pieces), np.uint64)
        for k in np.unique(sizes):
            keys[sizes == k] = hashes(off[sizes == k], int(k))
        self.order = np.argsort(keys)
        self.keys, self.score, self.longest = keys[self.order], score, int(sizes.max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def _log_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, starts)
    size = np.diff(np.append(starts, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size)), starts))


def expected_uses(words: pa.Array, n: np.ndarray, known: Pieces) -> np.ndarray:
    """Expected uses of each piece over all splits of the words, each as often as it occurs: forward and backward sums by
    position, for all words at once. Words that no pieces make up are left out."""
    raw, byte_off = flat(words)
    points = points_of(raw)
    off = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), byte_off)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(off[1:], size) - np.arange(len(points))  # characters from each to the end of its word
    hashes = SpanHashes(points)
    starts, ends, which = [], [], []
    for k in range(1, min(known.longest, int(size.max(initial=0))) + 1):
        at = np.flatnonzero(left >= k)
        piece = known.find(hashes(at, k))
        hit = piece >= 0
        at = at[hit]
        starts.append(at + row[at])
        ends.append(at + row[at] + k)
        which.append(piece[hit])
    used = np.zeros(len(known.keys))
    if not starts or not len(points):
        return used
    s, e, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(which)
    node = off[:-1] + np.arange(len(size))  # the first node of each word; the last is node + size
    first = np.repeat(node, size + 1)
    w = known.score[p]
    ahead, behind = np.full(len(first), -np.inf), np.full(len(first), -np.inf)
    ahead[node], behind[node + size] = 0.0, 0.0
    with np.errstate(invalid="ignore"):
        for depth, from_node, to_node, out in ((e - first[e], s, e, ahead), ((node + size)[np.searchsorted(node, s, "right") - 1] - s, e, s, behind)):
            order = np.lexsort((to_node, depth))
            levels = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
            for a, b in zip(levels[:-1], levels[1:]):
                arcs = order[a:b]
                arcs = arcs[out[from_node[arcs]] > -np.inf]
                if len(arcs):
                    to = to_node[arcs]
                    at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    out[to[at]] = _log_sums(out[from_node[arcs]] + w[arcs], at)
        word = np.searchsorted(node, s, "right") - 1
        share = np.exp(ahead[s] + w + behind[e] - ahead[(node + size)[word]])
    return np.bincount(p, np.where(np.isfinite(share), share, 0.0) * n[word], len(used))


def _expected(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for slot in sorted(set(names)):
            known = models.value[slot]
            own = batch.filter(pa.array([x == slot for x in names]))
            found = expected_uses(own.column(1), own.column(2).to_numpy(), known)
            totals[slot] = totals[slot] + found if slot in totals else found
    for slot, found in totals.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([slot] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["slot", "piece", "uses"])


def unigram(counts: DataFrame, sizes: Mapping[str, tuple[int, int]], rounds: int = 2, keep: float = 0.75) -> dict[str, dict[str, float]]:
    """{slot: {piece: natural-log weight}} for {slot: (pieces, longest piece)}. From the most useful seeds, rounds of
    expectation-maximization and pruning down to the size; single characters stay."""
    spark = counts.sparkSession
    words = materialize(counts.where(F.col("slot").isin(list(sizes)) & (F.length("text") > 0)).select("slot", "text", F.col("n").cast("long")), "words")
    use: dict[str, dict[str, float]] = {}
    for slot, (size, longest) in sizes.items():
        seeds = materialize(seed_pieces(words.where(F.col("slot") == slot), longest), "seeds")
        single = seeds.where("length(piece) = 1")
        ranked = seeds.where("length(piece) > 1 and n > 1").orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(4 * size)
        use[slot] = {r["piece"]: float(r["n"]) for r in single.unionByName(ranked).orderBy("piece").collect()}  # a few times the budget
    done: dict[str, dict[str, float]] = {}
    k = 0
    while use:
        order = {s: list(p) for s, p in use.items()}
        models = {}
        for s, p in use.items():
            v = np.array(list(p.values()))
            models[s] = Pieces(order[s], np.log(v / v.sum()))
        shared = spark.sparkContext.broadcast(models)
        open_words = words.where(F.col("slot").isin(list(use)))
        sums = open_words.mapInArrow(lambda it, shared=shared: _expected(it, shared), "slot string, piece long, uses double").groupBy("slot", "piece").agg(F.sum("uses").alias("uses")).collect()
        found: dict[str, dict[str, float]] = {s: dict.fromkeys(p, 0.0) for s, p in use.items()}
        for r in sums:
            found[r["slot"]][order[r["slot"]][r["piece"]]] = round(r["uses"], 6)  # sums in another order are the same
        k += 1
        for s, p in found.items():
            own = {x: max(v, 1e-3 if len(x) == 1 else 0.0) for x, v in p.items() if v > 0.5 or len(x) == 1}
            use[s] = own
            if k % rounds == 0:
                size = sizes[s][0]
                if len(own) <= size:
                    done[s] = own
                else:
                    rank = sorted(own, key=lambda x: (len(x) > 1, -own[x] * len(x), x))
                    use[s] = {x: own[x] for x in sorted(rank[: max(size, int(len(rank) * keep))])}
        use = {s: p for s, p in use.items() if s not in done}
    return {s: {x: math.log(v / sum(p.values())) for x, v in sorted(p.items())} for s, p in done.items()}


def train_unigram(counts: DataFrame, size: int, longest: int = 8, rounds: int = 2, keep: float = 0.75) -> DataFrame:
    """(slot, piece, score): unigram pieces of each slot."""
    slots = [r["slot"] for r in counts.select("slot").distinct().collect()]  # at most as many as a layout has
    found = unigram(counts, {s: (size, longest) for s in slots}, rounds, keep)
    rows = [(s, x, w) for s, p in sorted(found.items()) for x, w in p.items()]
    return counts.sparkSession.createDataFrame(rows, "slot string, piece string, score double")
