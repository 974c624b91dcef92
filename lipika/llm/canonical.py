"""Problem 3: one consistent form for text that looks the same.

The whole batch is one code-point array. Lookup tables say for each code point what becomes of it; the
rest is gathers, expansion offsets and rounds over clusters, never a call per row:

1. invisible format characters and controls go; joiners stay only where they change the picture (after a
   virama, between Arabic letters, inside an emoji sequence), variation selectors only behind symbols;
2. wide, narrow and no-break forms, typographic spaces, hyphens and Latin ligatures become their plain form;
3. look-alike letters of Cyrillic, Greek and Armenian become Latin, unless the word has letters that only
   their script has; then the Latin look-alikes in it join that script;
4. marks are decomposed, ordered and composed canonically (the result is NFC).

Accents, case, raised digits, digits of other scripts, punctuation and line breaks are kept.
Null stays null, empty stays empty; the form of a form is itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import codepoints_of, row_index, to_arrow

SIZE = 0x110000
KEEP, DROP, EXPAND, JOINER, SELECTOR = 0, 1, 2, 3, 4

# Letters whose glyphs are the same, foreign letter and Latin letter at the same place.
CYRILLIC = ("аеорсухіѕјһԁԝԛӏАВЕКМНОРСТХІЅЈԌԜԚ", "aeopcyxisjhdwqlABEKMHOPCTXISJGWQ")
GREEK = ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX")
ARMENIAN = ("օՕՏ", "oOS")
SCRIPTS = (CYRILLIC, GREEK, ARMENIAN)
# Blocks of these scripts, and of scripts whose letters join.
SCRIPT_BLOCKS = (((0x400, 0x530),), ((0x370, 0x400), (0x1F00, 0x2000)), ((0x531, 0x590),))
JOINING_BLOCKS = ((0x600, 0x900), (0x1800, 0x18B0), (0x10A0, 0x10A0))
# Ligatures and digraphs drawn like their letters; hyphens drawn like the ASCII one.
LIGATURE_BLOCKS = ((0xFB00, 0xFB07), (0x132, 0x134), (0x1C4, 0x1CD), (0x1F1, 0x1F4))
HYPHENS = (0x2010, 0x2011)
# Signs drawn like a Greek letter (micro, increment) and that letter.
GREEK_SIGNS = {0xB5: 0x3BC, 0x2206: 0x394}
ZWNJ, ZWJ = 0x200C, 0x200D
LONG_CLUSTER = 64


class Tables:
    """All lookup tables, built once per worker from the Unicode database."""

    def __init__(self) -> None:
        self.action = np.zeros(SIZE, np.uint8)
        self.ccc = np.zeros(SIZE, np.uint8)
        self.word = np.zeros(SIZE, bool)  # letters and marks: what a word of one script is made of
        self.picture = np.zeros(SIZE, bool)
        self.decompose: dict[int, str] = {}
        expand: dict[int, str] = {}
        quick = set()
        pairs: dict[tuple[int, int], int] = {}
        for cp in [*range(0x32000), *range(0xE0000, 0xE0200)]:
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Cs", "Co"):
                continue
            self.ccc[cp] = unicodedata.combining(ch)
            self.word[cp] = cat[0] in "LM"
            self.picture[cp] = cat in ("So", "Sk", "Sm") and cp > 0x2000
            if cat == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0xE0020 <= cp < 0xE0080):
                self.action[cp] = JOINER if cp in (ZWNJ, ZWJ) else DROP
            elif cp == 0x34F or 0x180B <= cp <= 0x180D or cat == "Cc" and cp < 0x80 and ch not in "\t\n":
                self.action[cp] = DROP
            elif 0xFE00 <= cp <= 0xFE0F or cp >= 0xE0100:
                self.action[cp] = SELECTOR
            elif cat in ("Zl", "Zp"):
                expand[cp] = "\n"
            elif cat == "Zs" and cp != 0x20 and cp != 0x1680:
                expand[cp] = " "
            elif cp in HYPHENS:
                expand[cp] = "-"
            elif cp in GREEK_SIGNS:
                expand[cp] = chr(GREEK_SIGNS[cp])
            d = unicodedata.decomposition(ch)
            if d:
                tag = d.split()[0]
                if tag in ("<wide>", "<narrow>") and cp not in expand:
                    expand[cp] = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", ch))
                elif any(a <= cp < b for a, b in LIGATURE_BLOCKS):
                    expand[cp] = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", ch))
                elif tag[0] != "<":
                    self.decompose[cp] = unicodedata.normalize("NFD", ch)
                    parts = d.split()
                    if len(parts) == 2 and unicodedata.normalize("NFC", "".join(chr(int(p, 16)) for p in parts)) == ch:
                        pairs[int(parts[0], 16), int(parts[1], 16)] = cp
                    if not unicodedata.is_normalized("NFC", ch):
                        quick.add(cp)
        for cp, to in self.decompose.items():
            if cp not in expand and (any(to[0] in own for own, _ in SCRIPTS) or len(to) == 1):
                expand[cp] = to
        for cp in (0x0B, 0x0C, 0x85):
            expand[cp] = "\n"
            self.action[cp] = KEEP
        for cp in expand:
            self.action[cp] = EXPAND
            self.picture[cp] = False
        self.selected = self.action != KEEP
        self.selected[0x0D] = True  # a carriage return goes before a line feed and is one otherwise
        self.action[0x0D] = KEEP
        self.exp_start, self.exp_len, self.exp_flat = self._flat(expand)
        self.dec_start, self.dec_len, self.dec_flat = self._flat(self.decompose)
        self.must = np.zeros(SIZE, bool)
        self.must[list(quick)] = True
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        self.second = np.zeros(SIZE, bool)
        self.second[[b for _, b in pairs]] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True
        self.attach = self.second | (self.ccc > 0)
        self.home = np.zeros(SIZE, np.uint8)  # 1.. : a letter only this script has
        self.alike = np.zeros(SIZE, np.uint8)  # 1.. : a letter of this script drawn as a Latin one
        self.latin = np.arange(SIZE, dtype=np.uint32)
        self.native = np.tile(np.arange(0x80, dtype=np.uint32), (len(SCRIPTS) + 1, 1))
        for k, ((own, latin), blocks) in enumerate(zip(SCRIPTS, SCRIPT_BLOCKS), 1):
            for lo, hi in blocks:
                self.home[lo:hi] = np.where(self.word[lo:hi], k, 0)
            for a, b in zip(own, latin):
                self.home[ord(a)], self.alike[ord(a)], self.latin[ord(a)] = 0, k, ord(b)
                self.native[k, ord(b)] = ord(a)
        self.joining = np.zeros(SIZE, bool)
        for lo, hi in JOINING_BLOCKS:
            self.joining[lo:hi] = self.word[lo:hi]

    @staticmethod
    def _flat(mapping: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size, flat = np.zeros(SIZE, np.int32), np.ones(SIZE, np.uint8), []
        for cp, to in mapping.items():
            start[cp], size[cp] = len(flat), len(to)
            flat += map(ord, to)
        return start, size, np.array(flat or [0], np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _cut(points: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    return points[keep], left[off]


def _expand(points: np.ndarray, off: np.ndarray, where: np.ndarray, start, size, flat) -> tuple[np.ndarray, np.ndarray]:
    """Replace the points at ``where`` by their expansion: repeat, then gather by offset."""
    if not len(where):
        return points, off
    reps = np.ones(len(points), np.int64)
    reps[where] = size[points[where]]
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(reps, out=ends[1:])
    out = np.repeat(points, reps)
    n = reps[where]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(ends[where], n) + inner] = flat[np.repeat(start[points[where]], n) + inner]
    return out, ends[off]


def _visible(points: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Step 1 and 2."""
    if not t.selected[points].any():
        return points, off
    first = np.zeros(len(points) + 1, bool)
    first[off] = True
    nxt = np.append(points[1:], 0)
    nxt[first[1:]] = 0
    cr = points == 0x0D
    points = np.where(cr, np.uint32(0x0A), points)
    points, off = _cut(points, off, (t.action[points] != DROP) & ~(cr & (nxt == 0x0A)))
    act = t.action[points]
    loose = np.flatnonzero((act == JOINER) | (act == SELECTOR))
    if len(loose):
        first = np.zeros(len(points) + 1, bool)
        first[off] = True
        before = np.where(first[loose] | (loose == 0), 0, points[loose - 1])
        after = np.where(first[loose + 1], 0, np.append(points, 0)[loose + 1])
        selector, zwj = act[loose] == SELECTOR, points[loose] == ZWJ
        emoji = t.picture[before] | (before == 0xFE0F)
        stay = np.where(selector, t.picture[before], (t.ccc[before] == 9) | (t.joining[before] & t.joining[after]) | (zwj & emoji & t.picture[after]))
        keep = np.ones(len(points), bool)
        keep[loose[~stay]] = False
        points, off = _cut(points, off, keep)
        act = t.action[points]
    return _expand(points, off, np.flatnonzero(act == EXPAND), t.exp_start, t.exp_len, t.exp_flat)


def _pair(a: np.ndarray, b: np.ndarray, t: Tables) -> np.ndarray:
    """The composition of each pair, 0 where there is none."""
    key = (a.astype(np.int64) << 21) | b
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    out = np.where(t.pair_keys[at] == key, t.pair_to[at], 0)
    lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lv, 0xAC00 + ((a.astype(np.int64) - 0x1100) * 21 + b - 0x1161) * 28, out)
    lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a.astype(np.int64) - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(lvt, a.astype(np.int64) + b - 0x11A7, out).astype(np.uint32)


def _compose(points: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Step 4: only clusters in which something can change are touched."""
    attach = t.attach[points]
    first = np.zeros(len(points) + 1, bool)
    first[off] = True
    follows = np.append(attach[1:], False) & ~first[1:]
    where = np.flatnonzero((t.dec_len[points] > 1) & follows | t.must[points])
    if not len(where) and not attach.any():
        return points, off
    if len(where):
        points, off = _expand(points, off, where, t.dec_start, t.dec_len, t.dec_flat)
        attach = t.attach[points]
        first = np.zeros(len(points) + 1, bool)
        first[off] = True
    head = ~attach | first[:-1]
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(points)))
    cluster = np.repeat(np.arange(len(heads)), size)
    ccc = t.ccc[points]
    # canonical order inside runs of marks; a starter ends such a run
    marks = ccc > 0
    wrong = np.flatnonzero(marks[1:] & marks[:-1] & (ccc[1:] < ccc[:-1]) & (cluster[1:] == cluster[:-1]))
    if len(wrong):
        bad = np.zeros(len(heads), bool)
        bad[cluster[wrong]] = True
        at = np.flatnonzero(bad[cluster])
        run = np.cumsum(~marks | head)[at]
        order = np.lexsort((at, np.where(marks[at], ccc[at], 0), run))
        # a starter opens its run: its number precedes that of the marks behind it
        points = points.copy()
        points[at] = points[at][order]
        ccc = t.ccc[points]
    busy = np.zeros(len(heads), bool)
    busy[cluster[t.second[points] & ~head]] = True
    live = np.flatnonzero(busy)
    if not len(live):
        return points, off
    points, keep = points.copy(), np.ones(len(points), bool)
    for c in live[size[live] > LONG_CLUSTER]:
        a, b = heads[c], heads[c] + size[c]
        done = np.frombuffer(unicodedata.normalize("NFC", points[a:b].tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
        points[a : a + len(done)], keep[a + len(done) : b] = done, False
    live = live[size[live] <= LONG_CLUSTER]
    starter, last = heads[live].copy(), np.full(len(live), -1)  # last: class of the mark before, -1 right behind the starter
    last[ccc[starter] > 0] = 256  # text that begins with a mark has no starter there
    for k in range(1, int(size[live].max(initial=1))):
        on = size[live] > k
        live, starter, last = live[on], starter[on], last[on]
        pos = heads[live] + k
        c = ccc[pos].astype(np.int64)
        to = _pair(points[starter], points[pos], t)
        ok = (to > 0) & ((last == -1) | ((last < c) & (last > 0)))
        points[starter[ok]] = to[ok]
        keep[pos[ok]] = False
        restart = ~ok & (c == 0)
        starter = np.where(restart, pos, starter)
        last = np.where(restart, -1, np.where(ok, last, np.where(c > 0, np.maximum(c, last), last)))
    return _cut(points, off, keep)


def _look_alikes(points: np.ndarray, off: np.ndarray, t: Tables) -> np.ndarray:
    """Step 3, on letters whose marks are still apart."""
    home = t.home[points]
    own, alike = np.flatnonzero(home), np.flatnonzero(t.alike[points])
    if not len(own) and not len(alike):
        return points
    edge = ~t.word[points]
    edge[off[:-1][off[:-1] < len(points)]] = True
    word = np.cumsum(edge)
    script = np.zeros(word[-1] + 1, np.uint8)
    for k in range(len(SCRIPTS), 0, -1):  # the first script of the list decides in a word with several
        script[word[own[home[own] == k]]] = k
    out = points.copy()
    out[alike] = np.where(script[word[alike]] == 0, t.latin[points[alike]], points[alike])
    in_script = script[word]
    at = np.flatnonzero((in_script > 0) & (points < 0x80))
    out[at] = t.native[in_script[at], points[at]]
    return out


def canonical_points(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    if len(points) and points.max() >= 0x80 or t.selected[points].any():
        points, off = _visible(points, off, t)
        points = _look_alikes(points, off, t)
        points, off = _compose(points, off, t)
    return points, off


def canonical_array(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    points, off = canonical_points(*codepoints_of(column))
    return to_arrow(points, off, column)


def canonical(text: Column) -> Column:
    """The consistent form of a text column."""

    @F.arrow_udf("string")
    def canonical_form(v: pa.Array) -> pa.Array:
        return canonical_array(v)

    return canonical_form(text)


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical_text") -> DataFrame:
    return df.withColumn(out, canonical(F.col(text)))


__all__ = ["canonical", "canonical_array", "canonical_points", "row_index", "with_canonical"]
