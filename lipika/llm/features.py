"""Word features of canonical text, shared by the near-duplicate and the cross-split operators.

A record's words (pieces between white space of its consistent form) become 64-bit hashes by one polynomial
prefix sum over the batch's code points; the k-th occurrence of a word in a record is a feature of its own,
so that a set of features stands for the record's multiset of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import codepoints_of, mix64, row_index
from .canonical import canonical_points

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out again
CHECK = 0xD1B54A32D192ED03
SKETCHES = ("sketch_a", "sketch_b", "sketch_c", "sketch_d")
LOOK_SCHEMA = "doc_id string, look binary, raw binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n + 1, np.uint64)
    up[0] = 1
    up[1:] = np.uint64(BASE)
    down = up.copy()
    down[1:] = np.uint64(pow(BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the flat code points, the same wherever it stands."""
    up, down = _powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(BASE)) * up[:-1], out=total[1:])
    size = (end - start).astype(np.uint64)
    return mix64((total[end] - total[start]) * down[start] + mix64(size))


def words_of(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    inside = (points != 0x20) & (points != 0x0A) & (points != 0x09)
    first = np.zeros(len(points) + 1, bool)
    first[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(points) else inside
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(points) else inside
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def bags(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, times) of each distinct word of each row, sorted by row and hash."""
    start, end, row = words_of(points, off)
    word = span_hashes(points, start, end)
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    return row[at], word[at], np.diff(np.append(at, len(row)))


def binary_rows(values: np.ndarray, per_row: np.ndarray, width: int) -> pa.Array:
    """Rows of packed numbers as an Arrow binary column; per_row counts the numbers of each row."""
    ends = np.concatenate([[0], np.cumsum(per_row)]) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def digests(points: np.ndarray, off: np.ndarray) -> pa.Array:
    """16 bytes for each row's whole text."""
    a = span_hashes(points, off[:-1], off[1:])
    b = span_hashes(points ^ np.uint32(0x155555), off[:-1], off[1:])
    return binary_rows(np.stack([a, b], 1), np.full(len(off) - 1, 2), 8)


def bag_ids(word: np.ndarray, times: np.ndarray, per_row: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums for each row's multiset of words, whatever their order: the class of a record and its check."""
    ends = np.concatenate([[0], np.cumsum(per_row)])
    out = []
    for base in (BASE, CHECK):
        each = mix64(word + np.uint64(base) * times.astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
        out.append(mix64(total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out


def occurrences(word: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One hash for each occurrence: the k-th of a word differs from its first."""
    n = times.astype(np.int64)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix64(np.repeat(word, n) + (place.astype(np.uint64) << np.uint64(32)))


def linear_maps(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random odd multipliers and addends, the same everywhere."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def schema(parts: int) -> str:
    named = "".join(f"{k} long, " for k in SKETCHES[:parts])
    return f"doc_id string, split string, text_id long, class_id long, check long, words int, {named}features binary, counts binary"


def sketches(features: np.ndarray, times: np.ndarray, off: np.ndarray, parts: int = 2) -> list[np.ndarray]:
    """``parts`` 64-bit sketches of each non-empty row: one bit of each of 64 MinHash values. Of two records with
    similarity s the bits agree with probability (1 + s) / 2."""
    x = occurrences(features.astype(np.uint64), times)
    starts = np.concatenate([[0], np.cumsum(times.astype(np.int64))])[off[:-1]]
    mult, add = linear_maps(64 * parts, 7)
    out = []
    for part in range(parts):
        bits = np.zeros(len(starts), np.uint64)
        for k in range(64 * part, 64 * part + 64):
            least = mix64(np.minimum.reduceat(x * mult[k] + add[k], starts))
            bits = (bits << np.uint64(1)) | (least >> np.uint64(63))
        out.append(bits.view(np.int64))
    return out


def _features(batches: Iterator[pa.RecordBatch], least: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("text"))
        raw, raw_off = codepoints_of(text)
        points, off = canonical_points(raw, raw_off)
        row, word, times = bags(points, off)
        rows = len(text)
        size = np.bincount(row, times, rows).astype(np.int64)
        keep = size >= least
        mine, distinct = keep[row], np.bincount(row, minlength=rows)
        out = [batch.column(names.index("doc_id")), batch.column(names.index("split")), batch.column(names.index("text_id")), *map(pa.array, bag_ids(word, times, distinct)), pa.array(size.astype(np.int32))]
        out = [x.filter(pa.array(keep)) for x in out]
        # features are kept by their upper 32 bits, which are sorted as the whole hashes are
        words32, times32 = (word[mine] >> np.uint64(32)).astype("<u4"), times[mine].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(distinct[keep])])
        out += [pa.array(x) for x in (sketches(words32, times32, ends, parts) if len(words32) else [np.zeros(0, np.int64)] * parts)]
        out.append(binary_rows(words32, distinct[keep], 4))
        out.append(binary_rows(times32, distinct[keep], 4))
        yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema(parts).split(", ")])


def _looks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("text"))
        raw, raw_off = codepoints_of(text)
        points, off = canonical_points(raw, raw_off)
        _, _, row = words_of(points, off)
        keep = pa.array(np.bincount(row, minlength=len(text)) >= least)
        out = [batch.column(names.index("doc_id")), digests(points, off), digests(raw, raw_off)]
        yield pa.RecordBatch.from_arrays([x.filter(keep) for x in out], names=[x.split()[0] for x in LOOK_SCHEMA.split(", ")])


def _given(docs: DataFrame) -> DataFrame:
    split = F.col("split").cast("string") if "split" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"), split.alias("split")).where("doc_id is not null and length(text) > 0")


def word_features(docs: DataFrame, least_words: int = 8, parts: int = 2) -> DataFrame:
    """One row per record with at least ``least_words`` words: text_id (equal for equal stored texts), class_id and check (both
    equal for equal multisets of words), its distinct words as sorted hashes packed into ``features``, how often each
    occurs in ``counts``, and ``parts`` sketches.

    ``docs`` needs doc_id and text, and split where splits matter; other columns are ignored. Rows without doc_id or
    text are left out, as are empty and short texts. Repeated deliveries stay repeated rows. Word hashes have 32 bits:
    two records of n words share a false word with probability n*n / 2**32.
    """
    return _given(docs).withColumn("text_id", F.xxhash64("text")).mapInArrow(lambda it: _features(it, least_words, parts), schema(parts))


def text_looks(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """For each record with enough words 128-bit digests of its consistent form (look) and of its stored text (raw)."""
    return _given(docs).select("doc_id", "text").mapInArrow(lambda it: _looks(it, least_words), LOOK_SCHEMA)


def unpack(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, row offsets) of a packed binary column."""
    from .arrowtext import bytes_of

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, off = bytes_of(column)
    numbers = np.frombuffer(raw.tobytes(), kind)
    return numbers, off // np.dtype(kind).itemsize


__all__ = ["bags", "binary_rows", "row_index", "span_hashes", "text_looks", "unpack", "word_features", "words_of"]
