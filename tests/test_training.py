"""Distributed trainers against sequential statements of what they compute."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from lipika.operators import codec, training


def sequential(words, merges):
    """Counts of the merges one after the other: always the most frequent pair."""
    parts = {w: list(w) for w in words}
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(parts[w], parts[w][1:]):
                pairs[p] += n
        if not pairs or max(pairs.values()) < 2:
            break
        best = min(pairs, key=lambda p: (-pairs[p], [ord(c) for c in p[0] + p[1]]))
        out.append(pairs[best])
        for w, old in parts.items():
            new, i = [], 0
            while i < len(old):
                if tuple(old[i : i + 2]) == best:
                    new.append(old[i] + old[i + 1])
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            parts[w] = new
    return out


def test_first_merges_are_those_of_the_sequential_algorithm(spark, monkeypatch):
    monkeypatch.setattr(training, "SHARE", 1.0)
    rng = random.Random(4)
    words = Counter("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(400))
    counts = spark.createDataFrame([("S", w, n) for w, n in words.items()], "slot string, text string, n long")
    plan = training.bpe(counts, {"S": training.Merges(25, 48)})["S"]
    assert len(set(plan.pieces.values())) == 25
    want = sequential(words, len(plan.found))
    got = [n for *_, n in plan.found]
    assert got[:8] == want[:8] and abs(sum(got) - sum(want)) <= 0.02 * sum(want)


def test_equal_symbols_merge_from_the_left():
    row = np.zeros(5, np.int64)
    got, _ = training.apply_merges(np.array([7, 7, 7, 7, 7]), row, [(7, 7, 9)])
    assert got.tolist() == [9, 9, 7]
    got, rows = training.apply_merges(np.array([1, 2, 1, 2]), np.array([0, 1, 1, 1]), [(1, 2, 5)])
    assert got.tolist() == [1, 2, 5] and rows.tolist() == [0, 1, 1]


def test_bytes_and_all_slots_at_once(spark):
    counts = spark.createDataFrame([("A", "éé", 5), ("B", "abab", 3), ("B", None, 3), ("B", "", 1)], "slot string, text string, n long")
    rows = {(r["slot"], r["rank"]): (r["left"], r["right"], r["n"]) for r in training.train_bpe(counts, 2).collect()}
    assert rows[("A", 0)] == ("c3", "a9", 10) and rows[("B", 0)] == ("61", "62", 6)
    assert training.train_bpe(counts.limit(0), 2).count() == 0


def brute(words, score):
    used = Counter()
    for w, n in words.items():
        splits = []
        for cuts in product([0, 1], repeat=len(w) - 1):
            pieces, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    pieces.append(w[at:i])
                    at = i
            if all(p in score for p in pieces):
                splits.append((math.exp(sum(score[p] for p in pieces)), pieces))
        total = sum(x for x, _ in splits)
        for x, pieces in splits:
            for p in pieces:
                used[p] += n * x / total
    return used


def test_expected_uses_are_those_over_all_splits():
    pieces = ["a", "b", "c", "ab", "bc", "abc", "न", "नम", "म"]
    score = {p: -1.0 - 0.3 * k for k, p in enumerate(pieces)}
    words = {"abcab": 3, "a": 1, "bcbc": 2, "नमन": 4, "xa": 5}
    known = training.Pieces(pieces, np.array(list(score.values())))
    got = training.expected_uses(pa.array(list(words)), np.array(list(words.values())), known)
    want = brute(words, score)
    assert all(abs(g - want[p]) < 1e-9 for p, g in zip(pieces, got))


def test_unigram_is_the_same_on_any_partitioning(spark):
    rows = [("A", w, n) for w, n in Counter("the lantern the river lantern rivers moving moves".split() * 5).items()]
    counts = spark.createDataFrame(rows, "slot string, text string, n long")
    a, b = (sorted(map(tuple, training.train_unigram(c, 20).collect())) for c in (counts, counts.repartition(7)))
    assert a == b and len(a) <= 20 and {"l", "v"} <= {p for _, p, _ in a}
    assert abs(sum(math.exp(w) for *_, w in a) - 1) < 1e-9


def test_merges_encode_by_rank():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("a", "a"): 3}
    assert codec.merged("abcab", ranks) == ["abc", "ab"]
    assert codec.merged("aaaaa", ranks) == ["aa", "aa", "a"]
    assert codec.merged("", ranks) == [] and codec.merged("x", ranks) == ["x"]
