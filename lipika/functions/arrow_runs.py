"""Runs of one slot in a batch of texts, on flat Arrow buffers: lookups, running maxima and slices, no call per row.

A batch is one code-point array. A table gives the class of each code point; structural spans, inherited marks and
white space are settled by running maxima over positions; a run is a slice of the text's own buffer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .scripts import CODE_MATH, COMMON, JOINERS, SCRIPT_RANGES, SPACE_CONTROLS, STRUCT, UNKNOWN

RUN_TYPE = "array<struct<slot:string,text:string,start:int,end:int,script:string>>"
# Classes: before any other, COMMON, white space, inherited, structural, UNKNOWN, then the scripts.
START, COMMON_CLASS, SPACE, MARK, SPAN, UNKNOWN_CLASS = range(6)
SCRIPT_OF_CLASS = [COMMON, COMMON, COMMON, "INHERITED", CODE_MATH, UNKNOWN, *SCRIPT_RANGES]
STRUCTURE = re.compile(STRUCT)
PART = 1 << 20  # characters that are cut in one go, about; keeps the position arrays small


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, combining class, may change under NFC) by code point."""
    own = np.full(0x110000, UNKNOWN_CLASS, np.uint8)
    ccc, loose = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    block = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPT_RANGES.values()):
        for lo, hi in ranges:
            block[lo : hi + 1] = 6 + k
    for cp in (*range(0x33480), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "Z" or ch in SPACE_CONTROLS:
            own[cp] = SPACE
        elif cat[0] in "NPS":
            own[cp] = COMMON_CLASS
        elif block[cp]:
            own[cp] = block[cp]
        elif cat[0] == "M" or any(lo <= cp <= hi for lo, hi in JOINERS):
            own[cp] = MARK
        ccc[cp] = unicodedata.combining(ch)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<":
            loose[cp] = not unicodedata.is_normalized("NFC", ch)
            for part in parts.split()[1:]:
                loose[int(part, 16)] = True  # a second part may compose with what stands before it
    loose[0x1161:0x1176] = loose[0x11A8:0x11C3] = True
    return own, ccc, loose


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets into them) of a string array."""
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def points_of(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def composed(column: pa.Array) -> pa.Array:
    """Canonical composition. Only rows with something that may change by it are touched; null stays null."""
    raw, off = flat(column)
    if not len(raw) or raw.max() < 0xCC:  # no code point from U+0300 on
        return column
    points = points_of(raw)
    _, ccc, loose = tables()
    own = ccc[points]
    change = loose[points]
    change[1:] |= (own[1:] > 0) & (own[:-1] > own[1:])
    if not change.any():
        return column
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    rows = np.zeros(len(column), bool)
    rows[np.searchsorted(off, starts[change], "right") - 1] = True
    mask = pa.array(rows)
    done = [unicodedata.normalize("NFC", t) for t in column.filter(mask).to_pylist()]
    return pc.replace_with_mask(column, mask, pa.array(done, column.type))


@dataclass
class Runs:
    """The runs of a batch in text order; ``offsets`` are the rows' bounds in them."""

    offsets: np.ndarray
    slot: pa.Array
    text: pa.Array
    start: np.ndarray
    end: np.ndarray
    script: pa.Array

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def fields(self) -> list[pa.Array]:
        return [self.slot, self.text, pa.array(self.start), pa.array(self.end), self.script]

    def structs(self) -> pa.Array:
        kind = pa.StructArray.from_arrays(self.fields(), ["slot", "text", "start", "end", "script"])
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), kind)


class Cutter:
    """Cuts batches by a map from classes to slots."""

    def __init__(self, slot_map: Mapping[str, str], mode: str, structural: str, neutral: str, rest: str, form: str) -> None:
        if mode not in ("leading", "neutral"):
            raise ValueError(f"unknown white space mode {mode!r}: leading or neutral")
        slots = [slot_map.get(s, rest) for s in SCRIPT_OF_CLASS]
        slots[START], slots[SPAN] = neutral, structural
        self.names = sorted(set(slots))
        self.slot_of = np.array([self.names.index(s) for s in slots], np.uint8)
        self.mode, self.form = mode, form

    def parts(self, text: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(first row, rows) of slices with about PART bytes."""
        _, off = flat(text)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(off, off[at] + PART, "right")) - 1)
            yield at, text.slice(at, to - at)
            at = to

    def classes(self, text: pa.Array, points: np.ndarray, first: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The settled class of each code point; ``off`` are the rows' bounds in points, ``first`` each point's row start."""
        own = tables()[0][points]
        ends = np.repeat(off[1:], np.diff(off))
        pos = np.arange(len(points), dtype=np.int64)
        marks = (points == 0x60) | (points == 0x24) | (points == 0x5C)
        if marks.any():
            for k in np.unique(np.searchsorted(off, np.flatnonzero(marks), "right") - 1):
                for m in STRUCTURE.finditer(text[int(k)].as_py()):
                    own[off[k] + m.start() : off[k] + m.end()] = SPAN
        mark = own == MARK
        if mark.any():  # the class before, not of a span; behind white space that of COMMON
            last = np.maximum.accumulate(np.where(mark | (own == SPAN), -1, pos))[mark]
            before = np.where(own[last] == SPACE, COMMON_CLASS, own[last])
            own[mark] = np.where(last >= first[mark], before, START)
        space = own == SPACE
        if self.mode == "neutral":
            own[space] = COMMON_CLASS
        elif space.any():  # the class behind, at the end of a row that before
            ahead = np.minimum.accumulate(np.where(space, len(points), pos)[::-1])[::-1][space]
            behind = np.maximum.accumulate(np.where(space, -1, pos))[space]
            padded = np.append(own, START)
            own[space] = np.where(ahead < ends[space], padded[ahead], np.where(behind >= first[space], own[behind], START))
        return own

    def cut(self, text: pa.Array) -> Runs:
        """The runs of one slice; null and empty texts have none."""
        if self.form == "NFC":
            text = composed(text)
        raw, byte_off = flat(text)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        off = np.searchsorted(starts, byte_off)
        points = points_of(raw)
        row_start = np.repeat(off[:-1], np.diff(off))
        own = self.classes(text, points, row_start, off)
        slot = self.slot_of[own]
        edge = np.ones(len(slot), bool)
        edge[1:] = slot[1:] != slot[:-1]
        edge[off[:-1][off[:-1] < len(slot)]] = True
        at = np.flatnonzero(edge)
        end = np.append(at[1:], len(slot))[: len(at)]
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(starts[at], len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        base = row_start[at]
        return Runs(np.searchsorted(at, off), pa.array(self.names).take(pa.array(slot[at])), pieces, (at - base).astype(np.int32), (end - base).astype(np.int32), pa.array(SCRIPT_OF_CLASS).take(pa.array(own[at])))


def class_counts(text: pa.Array) -> np.ndarray:
    """How often each class, before anything is settled, occurs in the composed texts."""
    return np.bincount(tables()[0][points_of(flat(composed(text))[0])], minlength=len(SCRIPT_OF_CLASS))
