"""Arrow string columns as flat numpy arrays, without touching single rows.

A batch of texts becomes one code-point array plus row offsets; operators work on the flat array and
turn it back into an Arrow column. Null rows have zero length and stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets into them) of a string or binary array."""
    off = offsets_of(column)
    data = column.buffers()[2] if len(column) else None
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def codepoints_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets into them) of a string array; one decode for the whole batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, off = bytes_of(column)
    try:
        flat = raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass")
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
        return np.frombuffer(flat, np.uint32), starts[off]
    except UnicodeDecodeError:  # a broken file: bad bytes become U+FFFD row by row
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def to_arrow(points: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """The inverse of codepoints_of; nulls as in ``like``."""
    data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    out = pa.LargeStringArray.from_buffers(len(like), pa.py_buffer(ends[offsets]), pa.py_buffer(data))
    if like.null_count:
        out = pc.if_else(like.is_valid(), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def row_index(offsets: np.ndarray) -> np.ndarray:
    """For each element of the flat array its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizing permutation of 64-bit values (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
