"""Problem 2: near-duplicate records by MinHash banding.

One MinHash function is a random linear map of the word features of which the least value is kept. Rows and
bands follow from the similarity and the recall that are asked for. Only one record of each class of equal
word multisets is banded; band hashes with ids and sketches are the only thing shuffled per band, and every
candidate pair is verified on the full multisets of words. A band that many classes share is one key of a
sort-merge join whose exchanges stand right below it, so that adaptive execution splits it.

Pairs that meet by chance grow with the square of the collection. The join itself drops them by their sketches,
so that none is shuffled or written. Bands are joined a few at a time and candidates verified in slices, each
with its shuffle files gone before the next, so that disk use follows the records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped_shuffles, materialize, shuffle_partitions
from .arrowtext import mix64
from .features import SKETCHES, linear_maps, occurrences, unpack, word_features
from .similarity import CLASS, EXPAND, PAIR, heavy_classes, listed, memberships, new_in_task, ordered, same_class_pairs, sided, thinned, verified

SIMILARITY = 0.7  # TESTDATA.md: at least 0.7 of the words in common
ROWS = 7
RECALL = 0.98  # of pairs exactly at that similarity; 0.998 at 0.75 and 0.99998 at 0.8 with 46 bands of 7 rows
SKETCH_BITS = 128  # of two sketches
NEAR_BITS = 64 * len(SKETCHES)  # of the sketches by which pairs that met are thinned out
SKETCH_SIGMAS = 4  # a pair at the similarity passes the sketch unless its bits are that far below their mean
ROUND = 8  # bands that are shuffled at once
SLICE = 500_000  # pairs verified at once, or as many as there are records if that is more


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands that finds a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def agreeing_bits(similarity: float, sigmas: float = SKETCH_SIGMAS, bits: int = SKETCH_BITS) -> int:
    p = (1 + similarity) / 2
    return math.floor(bits * p - sigmas * math.sqrt(bits * p * (1 - p)))


def band_hashes(features: np.ndarray, counts: np.ndarray, off: np.ndarray, bands: int, rows: int, part: range) -> np.ndarray:
    """[record, band] hashes, for the bands of ``part``, of the (non-empty) records whose word hashes and counts stand in
    the flat arrays."""
    x = occurrences(features.astype(np.uint64), counts)
    starts = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])[off[:-1]]
    mult, add = linear_maps(bands * rows, 20240607)
    out = np.empty((len(starts), len(part)), np.uint64)
    for at, b in enumerate(part):
        key = np.full(len(starts), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mix64(key + np.minimum.reduceat(x * mult[k] + add[k], starts))
        out[:, at] = key
    return out


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int, part: range) -> Iterator[pa.RecordBatch]:
    for batch in new_in_task(batches):
        names = batch.schema.names
        about = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("class_id", *SKETCHES)]
        features, off = unpack(batch.column(names.index("features")), "<u4")
        counts, _ = unpack(batch.column(names.index("counts")), "<u4")
        if len(features):
            keys = band_hashes(features, counts, off, bands, rows, part)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(pa.array(np.repeat(x, len(part))) for x in about)], names=["band", "class_id", *SKETCHES])


def candidates(features: DataFrame, heavy: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Distinct pairs (a < b) of classes that share a band and whose sketches agree, written out. ``features`` must be.

    ROUND bands at a time, (band hash, class id, sketches) are shuffled; pairs whose sketches differ end in the join.
    What a pair meets in several bands is folded in each round and then over all.
    """
    spark = features.sparkSession
    bands = bands_for(similarity, recall, rows)
    given = thinned(features, heavy).select(*CLASS, *SKETCHES, "features", "counts")
    apart = " + ".join(f"bit_count(x.{k} ^ y.{k})" for k in SKETCHES)
    meet = F.expr(f"x.band = y.band and x.class_id < y.class_id and {apart} <= {NEAR_BITS - agreeing_bits(similarity, bits=NEAR_BITS)}")
    row = ", ".join(f"{k} long" for k in ("band", "class_id", *SKETCHES))
    found = []
    with shuffle_partitions(spark, features.count() * ROUND, 48), dropped_shuffles(spark):
        for first in range(0, bands, ROUND):
            part = range(first, min(first + ROUND, bands))
            keyed = given.mapInArrow(lambda it, part=part: _bands(it, bands, rows, part), row)
            met = keyed.alias("x").join(keyed.alias("y").hint("merge"), meet)
            found.append(materialize(met.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b")).distinct(), "neardup-met"))
        return materialize(reduce(DataFrame.unionByName, found).distinct(), "neardup-candidates")


def similar_classes(features: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(a, check_a, b, check_b, similarity) of different classes at least this similar, written out. ``features`` must be."""
    spark = features.sparkSession
    with dropped_shuffles(spark):
        heavy = heavy_classes(features)
        pairs = candidates(features, heavy, similarity, recall, rows)
        records = features.count()
        slices = max(1, math.ceil(pairs.count() / max(records, SLICE)))
        own = [pairs.where(f"pmod(xxhash64(a, b), {slices}) = {k}") for k in range(slices)]
        with shuffle_partitions(spark, max(records, SLICE), 600):
            sure = [materialize(verified(x, features, heavy, similarity).drop("cosine"), "neardup-verified") for x in own]
        return reduce(DataFrame.unionByName, sure)


def near_duplicate_pairs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least_words: int = 8, expand: int = EXPAND) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first: different records with at least ``similarity`` of their words in common.

    Equal records are pairs too. More than ``expand`` exact copies of one stored text appear as pairs with their
    representative (the least doc_id), which also stands for them in pairs with other texts; near_duplicate_classes
    has every copy. Different texts are all written out, also those with equal multisets of words.
    Null ids or texts, empty texts and texts below ``least_words`` words are in no pair; extra columns are ignored; an
    empty table gives no rows.
    """
    features = materialize(word_features(docs, least_words, len(SKETCHES)), "neardup-features")
    pairs = similar_classes(features, similarity, recall)
    with dropped_shuffles(docs.sparkSession):
        members = materialize(memberships(features, *CLASS, "text_id"), "neardup-members")
    shown = listed(members, expand)
    one, two = (sided(shown, k, "doc_id") for k in "ab")
    across = pairs.join(one, ["a", "check_a"]).join(two, ["b", "check_b"])
    across = across.where("doc_id_a <> doc_id_b").select(*ordered("doc_id_a", "doc_id_b"))
    return across.unionByName(same_class_pairs(members, expand)).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number and order-free checksums of written edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node each node of the edges is connected with, by alternating star rounds.

    Large-star joins every greater neighbour to the least one, small-star every smaller one; both keep the
    components and together they end in stars after a few rounds. Each round is written out; the last is the one
    that changes nothing.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "stars")
    last = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "stars")
        this = _digest(now)
        if this == last:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = this


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least_words: int = 8) -> DataFrame:
    """One row per record with enough words: its class of equal records, the class's size, the least doc_id with the very
    same text, the number of similar other classes (links), and the group of all classes connected by links. Same rules
    as near_duplicate_pairs. Classes and groups are named by 32 hexadecimal digits."""
    features = materialize(word_features(docs, least_words, len(SKETCHES)), "neardup-features")
    name = [F.concat(F.lpad(F.hex(i), 16, "0"), F.lpad(F.hex(c), 16, "0")).alias(k) for i, c, k in (("a", "check_a", "a"), ("b", "check_b", "b"), ("class_id", "check", "class_id"))]
    pairs = materialize(similar_classes(features, similarity, recall).select(*PAIR).select(*name[:2]), "neardup-pairs")
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected(pairs).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    copies = memberships(features, *CLASS, "text_id").groupBy(*CLASS, "doc_id").agg(F.min("representative").alias("representative"))
    members = copies.select(name[2], "doc_id", "representative")
    sizes = features.select(*CLASS, "doc_id").distinct().groupBy(*CLASS).agg(F.count("*").alias("class_size")).select(name[2], "class_size")
    about = sizes.join(links, "class_id", "left").join(groups, "class_id", "left")
    return members.join(about, "class_id").select("doc_id", "class_id", "class_size", "representative", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
