"""What the near-duplicate and the cross-split operators share: exact overlaps of pairs and the way back to records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import unpack

EXPAND = 256  # up to so many exact copies of one stored text are all written out in pairs, of more only the least doc_id


def overlaps(fa: pa.Array, ca: pa.Array, fb: pa.Array, cb: pa.Array) -> np.ndarray:
    """For each row the number of words in both records, repeated words as often as both have them."""
    a, aoff = unpack(fa, "<u4")
    b, boff = unpack(fb, "<u4")
    na, _ = unpack(ca, "<u4")
    nb, _ = unpack(cb, "<u4")
    rows = len(aoff) - 1
    arow = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(aoff))
    brow = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(boff))
    ka, kb = (arow << np.uint64(32)) | a, (brow << np.uint64(32)) | b
    if not len(ka):
        return np.zeros(rows, np.int64)
    at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
    hit = ka[at] == kb
    return np.bincount(brow[hit].astype(np.int64), np.minimum(na[at[hit]], nb[hit]), rows).astype(np.int64)


def dots(fa: pa.Array, ca: pa.Array, fb: pa.Array, cb: pa.Array) -> np.ndarray:
    """For each row the dot product of the vectors with weight sqrt(times) for each word."""
    a, aoff = unpack(fa, "<u4")
    b, boff = unpack(fb, "<u4")
    na, _ = unpack(ca, "<u4")
    nb, _ = unpack(cb, "<u4")
    rows = len(aoff) - 1
    arow = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(aoff))
    brow = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(boff))
    ka, kb = (arow << np.uint64(32)) | a, (brow << np.uint64(32)) | b
    if not len(ka):
        return np.zeros(rows)
    at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
    hit = ka[at] == kb
    return np.bincount(brow[hit].astype(np.int64), np.sqrt(na[at[hit]].astype(float) * nb[hit].astype(float)), rows)


def _verify(batches: Iterator[pa.RecordBatch], least: float, cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        parts = col["features_a"], col["counts_a"], col["features_b"], col["counts_b"]
        wa, wb = (col[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("words_a", "words_b"))
        common = overlaps(*parts)
        share = common / np.maximum(wa + wb - common, 1)
        keep = share >= least
        cos = dots(*parts) / np.sqrt(wa.astype(float) * wb) if cosine else share
        keep &= cos >= cosine
        yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (*(col[c] for c in PAIR), pa.array(share), pa.array(cos))], names=[*PAIR, "similarity", "cosine"])


CLASS = ("class_id", "check")  # what names a class of equal multisets of words
PAIR = ("a", "check_a", "b", "check_b")  # a pair of classes
SMALL = 2_000_000  # pairs up to this number may have their class ids broadcast (at most 32 MB), after counting
COPIES, HEAVY = 1000, 100_000  # classes with over COPIES records; so many of them, the largest, are thinned out (3 MB)


def heavy_classes(features: DataFrame) -> DataFrame:
    """(class_id, check, first): the largest classes of more than COPIES records with their least doc_id, written out."""
    heavy = features.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > COPIES)
    return materialize(heavy.orderBy(F.desc("n"), *CLASS).limit(HEAVY).drop("n"), "heavy")


def thinned(features: DataFrame, heavy: DataFrame) -> DataFrame:
    """``features`` without most copies: of a class in ``heavy`` only its least doc_id stays.

    Copies have the same words and so the same postings; leaving them in changes no result, it only repeats postings.
    So the bound HEAVY on the classes that are broadcast changes none either.
    """
    return features.join(F.broadcast(heavy), list(CLASS), "left").where("first is null or doc_id = first").drop("first")


def new_in_task(batches: Iterator[pa.RecordBatch], keep: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches with each class only once in a task, as far as the last ``keep`` classes are remembered."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        both = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in CLASS))
        fresh = [k for k, c in enumerate(both) if not (c in seen or seen.add(c))]
        if len(seen) > keep:
            seen.clear()
        if fresh:
            yield batch.take(pa.array(fresh))


def sided(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    """``rows`` with the names of one side of a pair of classes."""
    return rows.select(F.col("class_id").alias(side), F.col("check").alias(f"check_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def verified(pairs: DataFrame, features: DataFrame, heavy: DataFrame, least: float, cosine: float = 0.0) -> DataFrame:
    """(a, check_a, b, check_b, similarity, cosine): pairs (a, b) of class ids whose records share at least ``least`` of their
    words (and reach the cosine), exactly counted. Classes that share an id are told apart by their check.

    ``pairs`` must be written out (it is counted). Few pairs: their ids are broadcast, so that only the words
    of candidates are shuffled. Many: a plain join does. Words are shuffled once, by class id.
    """
    rows = thinned(features, heavy).select(*CLASS, "words", "features", "counts")
    if pairs.limit(SMALL + 1).count() <= SMALL:
        ids = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
        rows = rows.join(F.broadcast(ids), "class_id", "left_semi")
    rows = rows.repartition("class_id").dropDuplicates(list(CLASS))
    one, two = (sided(rows, k, "words", "features", "counts") for k in "ab")
    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    return both.mapInArrow(lambda it: _verify(it, least, cosine), "a long, check_a long, b long, check_b long, similarity double, cosine double")


def memberships(features: DataFrame, *by: str) -> DataFrame:
    """(*by, doc_id, copies, representative): each record once, however often it was delivered; copies are the records
    that share the columns ``by``, the representative is their least doc_id. No column of ``by`` may be null."""
    each = features.select(*by, "doc_id").distinct()
    return each.join(each.groupBy(*by).agg(F.count("*").alias("copies"), F.min("doc_id").alias("representative")), list(by))


def listed(members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """The members that stand for a text in pairs of records: all, or of more than ``expand`` exact copies their
    representative. Different texts of a class all stay."""
    return members.where((F.col("copies") <= expand) | (F.col("doc_id") == F.col("representative")))


def same_class_pairs(members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """Pairs of records with the same words: all that are listed, and of more than ``expand`` exact copies each with the
    representative."""
    shown = listed(members, expand).select(*CLASS, "doc_id")
    pairs = shown.alias("x").join(shown.alias("y"), F.expr("x.class_id = y.class_id and x.check = y.check and x.doc_id < y.doc_id")).select(F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b"))
    star = members.where((F.col("copies") > expand) & (F.col("doc_id") != F.col("representative"))).select(F.col("representative").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    return pairs.unionByName(star)


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b")]
