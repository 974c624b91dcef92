"""Problem 5: text that was read in another encoding than it was written in.

A wrong code page is a substitution cipher: each byte stands for the letter of the right page and shows the one
of the wrong page. Which two pages were swapped is unknown and differs between sources, so it is learned:

1. language bigrams are counted over all records without UTF-8 bytes shown in a page and without characters of no text (a fixed alphabet, so the table
   is bounded), with a back-off to character classes;
2. each run of characters outside ASCII is deciphered by every swap that is possible for its characters: another
   single-byte page, or UTF-8 bytes shown in a page, once or repeatedly; the bigrams, with the letters around the
   run, say how much likelier each deciphered form is than the run as it stands;
3. expectation-maximization over all runs learns for each source how often it has which swap (and none); its
   statistics are counts of rounded log-likelihoods by source and swap, so they are bounded too;
4. a run is garbled where the posterior of "as it stands" is below a half (below 0.05 for the only one of a record). The learned byte-to-letter tables
   are applied with translate(); the original's UTF-8 bytes, where there are any, are then read as such.

5. runs that no page explains are a substitution cipher with unknown letters: expectation-maximization against the
   bigrams learns for each source which run stands for which letter, from no other knowledge than the letters around
   it, and the posterior decides as in 4.

U+FFFD stands for a byte that is lost. It is a swap like the others: what it may have been is read from the letters around
it, the posterior decides, and the sign itself stays in the restored text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few
from .arrowtext import codepoints_of, row_index
from .canonical import SCRIPTS

# The public code pages tried, as shown (wrong) and as written (right).
SHOWN = ("cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "cp1250", "iso8859_15", "cp850", "iso8859_2", "cp1254", "koi8_r", "cp866")
WRITTEN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251")
SHOWN_WIDE = ("gb18030", "big5", "shift_jis", "euc_kr")
# The alphabet of the bigram table.
ALPHABET = ((0x00, 0x180), (0x2B0, 0x530), (0x900, 0x980), (0xC80, 0xD00), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2150), (0x2200, 0x2300))
# Characters no text of these languages has (controls, box drawing, ideographs, private use, U+FFFD).
STRANGE = ((0x80, 0xA0), (0x2500, 0x25A0), (0x3040, 0xD800), (0xE000, 0xFB00), (0xFE10, 0xFE70), (0xFFF0, 0x10000))
DEPTH = 3
ENTRIES = 10_000  # registered entries; more are an error
LOST = "�"
ROUNDS, STRENGTH, CLIP, KEPT = 30, 20.0, 40, 3
SURE = 20.0  # nats by which UTF-8 bytes read as such must be likelier for other swaps not to be tried
FAINT = -8.0  # nats below the run as it stands from which a reading is not counted
LONE = 0.95  # the posterior that the only garbled run of a record needs
USUAL = 3  # a run all of whose bigrams are that frequent in sound records stands as it is
UNIT, WEIGHED = 3, 3.0  # characters of a run that may stand for one letter; nats from which a page explains a run
LETTER_ROUNDS, LETTER_STRENGTH = 25, 20.0
UNKNOWN = "letters of no known page"
UNSEEN = 8.0  # nats a reading loses for each character that no record has shown
RUN = re.compile("[^\x00-\x7f]+")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")


@lru_cache(None)
def page(name: str) -> tuple[dict[str, int], list[str]]:
    """({character: byte}, [character of each byte]) of a single-byte page; undefined bytes show as controls."""
    shown = []
    for b in range(256):
        try:
            shown.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            shown.append(chr(b))
    back = {c: b for b, c in reversed(list(enumerate(shown)))}
    return back, shown


@lru_cache(None)
def byte_table(shown: str) -> dict[int, int]:
    """translate() table from what a page shows to the bytes (as code points 0 to FF); other characters go to None."""
    return {ord(c): b for c, b in page(shown)[0].items()}


@lru_cache(None)
def shown_bytes(shown: str) -> dict[int, int]:
    """translate() table to bytes as code points up to FF; other characters that have such code points go beyond."""
    return {cp: 0xFFFF for cp in range(0x80, 0x100)} | byte_table(shown)


@lru_cache(None)
def letter_table(shown: str, written: str) -> dict[int, int]:
    """translate() table of a swap of two single-byte pages."""
    right = page(written)[1]
    return {ord(c): ord(right[b]) for c, b in page(shown)[0].items() if b >= 0x80}


SWAPS = [f"utf-8 shown as {w}" for w in (*SHOWN, *SHOWN_WIDE)] + [f"{r} shown as {w}" for w in SHOWN for r in WRITTEN if r != w and not (r == "cp1252" and w == "iso8859_15")]
SWAPS.append("bytes lost")
NUMBER = {s: i + 1 for i, s in enumerate(SWAPS)}  # 0: as it stands


def from_utf8(run: str, shown: str) -> str | None:
    """The run with the UTF-8 sequences among its bytes read as such; None if there are none."""
    if shown in SHOWN_WIDE:
        try:
            raw = run.replace(LOST, "").encode(shown)
        except UnicodeEncodeError:
            return None
        if not UTF8.search(raw):
            return None
        back = raw.decode("utf-8", "replace")
        return back if LOST not in back or back.count(LOST) * 2 <= len(back) else None
    raw = run.translate(shown_bytes(shown)).encode("latin-1", "replace")  # one byte for each character; ? where the page has none
    if not UTF8.search(raw):
        return None
    out, at = [], 0
    for m in UTF8.finditer(raw):
        out += [run[at : m.start()], m.group().decode("utf-8")]
        at = m.end()
    return "".join([*out, run[at:]])


@lru_cache(65536)
def kind(ch: str) -> str:
    """A coarse class for the back-off: category, and the script for letters and marks."""
    cp, cat = ord(ch), unicodedata.category(ch)
    if ch in " \n\t " or cat == "Zs":
        return "space"
    if cat[0] not in "LM":
        return ("ascii" if cp < 0x80 else "") + ("C" if cat[0] == "C" and cat != "Cf" else cat)
    block = "latin" if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else "greek" if 0x370 <= cp < 0x400 else "cyrillic" if 0x400 <= cp < 0x530 else "deva" if 0x900 <= cp < 0x980 else "knda" if 0xC80 <= cp < 0xD00 else "wide" if 0x2E80 <= cp < 0xD7B0 else "other"
    return block + cat + ("+" if block == "latin" and cp >= 0x80 else "")


ROOM = {"C": 2000, "So": 3000, "Sm": 900, "Sc": 60, "Po": 400, "widelLo": 60000, "wideLo": 60000}  # code points a class has, about


class Bigrams:
    """log P(next | character): counted pairs, backed off to classes of characters."""

    def __init__(self, pairs: dict[tuple[str, str], int]) -> None:
        self.pairs, self.first = pairs, Counter()
        single, between, classes, members = Counter(), Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            self.first[a] += n
            single[b] += n
            between[kind(a), kind(b)] += n
            classes[kind(a)] += n
        for c, n in single.items():
            members[kind(c)] += n
        self.single, self.between, self.classes, self.members = single, between, classes, members
        self.cache: dict[tuple[str, str], float] = {}
        self.between_two: dict[tuple[str, str], str] = {}
        self.beyond = sorted(c for c in single if c >= "\x80")
        self.seen = set(single) | {c for a in ALPHABET[:1] for c in map(chr, range(*a))}

    def log(self, a: str, b: str) -> float:
        hit = self.cache.get((a, b))
        if hit is None:
            ka, kb = kind(a), kind(b)
            step = (self.between[ka, kb] + 0.01) / (self.classes[ka] + 1)
            own = (self.single[b] + 0.05) / (self.members[kb] + 0.05 * ROOM.get(kb, 250))
            n = self.first[a]
            hit = self.cache[a, b] = math.log(0.95 * self.pairs.get((a, b), 0) / (n + 1) + 0.05 * step * own + 1e-12)
        return hit

    def usual(self, left: str, run: str, right: str) -> bool:
        """Whether records without garbling show each step of the run at least USUAL times."""
        a = left
        for b in run + right:
            if self.pairs.get((a, b), 0) < USUAL:
                return False
            a = b
        return True

    def letter(self, left: str, right: str) -> str:
        """The likeliest character outside ASCII between two others."""
        hit = self.between_two.get((left, right))
        if hit is None:
            hit = self.between_two[left, right] = max(self.beyond, key=lambda c: self.log(left, c) + self.log(c, right), default=LOST)
        return hit

    def score(self, left: str, run: str, right: str) -> float:
        total, a = 0.0, left
        for b in run + right:
            total += self.log(a, b)
            a = b
        return total - UNSEEN * len(set(run) - self.seen)


def _index() -> np.ndarray:
    out, n = np.zeros(0x110000, np.int32), 1
    for lo, hi in ALPHABET:
        out[lo:hi] = np.arange(n, n + hi - lo)
        n += hi - lo
    return out


@lru_cache(1)
def _inside() -> np.ndarray:
    """Characters that don't stand between two small Latin letters in sound text."""
    out = np.zeros(0x110000, bool)
    for cp in range(0x80, 0x3000):
        cat = unicodedata.category(chr(cp))
        out[cp] = cat[0] != "M" and cat not in ("Cf", "Pd", "Pf", "Pi", "Zs") and not (cat == "Ll" and kind(chr(cp)).startswith("latin"))
    return out


@lru_cache(1)
def _lookups() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(alphabet index, strange, worth a look) by code point, and the alphabet's code points."""
    index = _index()
    strange, look = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for lo, hi in STRANGE:
        strange[lo:hi] = True
    look[0x80:0x900] = True
    look[[0xA0, 0xAB, 0xBB, 0xAD, 0x2212]] = False
    look[0x300:0x370] = False
    look |= strange
    look[0x2020:0x2023] = look[0x2030] = look[0x2039:0x203B] = look[0x20A0:0x20C0] = look[0x2100:0x2190] = look[0x2213:0x2400] = True
    look[0xFE00:0xFE10] = look[0xFEFF] = False
    letters = [0, *(cp for lo, hi in ALPHABET for cp in range(lo, hi))]
    return index, strange, look, letters


@lru_cache(1)
def _bytes_shown() -> list[np.ndarray]:
    """For the single-byte pages the byte (80 to FF) that a code point shows, else 0."""
    out = []
    for w in SHOWN:
        if w in ("cp866", "koi8_r"):  # there sound Cyrillic words often look like UTF-8
            continue
        table = np.zeros(0x110000, np.uint8)
        for cp, b in byte_table(w).items():
            table[cp] = b if b >= 0x80 else 0
        out.append(table)
    return out


def shows_utf8(points: np.ndarray) -> np.ndarray:
    """Where a lead byte of UTF-8 and its continuation bytes stand, in whatever page they are shown."""
    hit = np.zeros(len(points), bool)
    for table in _bytes_shown():
        b = np.concatenate([table[points], np.zeros(3, np.uint8)])
        more = (b >= 0x80) & (b < 0xC0)
        two, three = more[1:-2], more[1:-2] & more[2:-1]
        lead = b[:-3]
        hit |= (lead >= 0xC2) & (lead < 0xE0) & two | (lead >= 0xE0) & (lead < 0xF0) & three | (lead >= 0xF0) & (lead < 0xF5) & three & more[3:]
    return hit


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, strange, look, letters = _lookups()
    inside = _inside()
    n = len(letters)
    total = np.zeros(n * n, np.int64)
    for batch in batches:
        points, off = codepoints_of(batch.column(0))
        row = row_index(off)
        bad = np.zeros(len(off) - 1, bool)
        bad[row[strange[points]]] = True
        doubtful = np.zeros(len(off) - 1, bool)
        doubtful[row[look[points]]] = True
        part = np.flatnonzero(doubtful[row])
        bad[row[part[shows_utf8(points[part])]]] = True
        small = (points >= 0x61) & (points <= 0x7A)
        mid = np.flatnonzero(inside[points])
        mid = mid[(mid > 0) & (mid < len(points) - 1)]
        bad[row[mid[small[mid - 1] & small[mid + 1]]]] = True
        use = ~bad[row]
        use[off[:-1][off[:-1] < len(points)]] = False  # no pair across rows
        b = np.flatnonzero(use[1:]) + 1 if len(points) else np.zeros(0, np.int64)
        total += np.bincount(index[points[b - 1]].astype(np.int64) * n + index[points[b]], minlength=n * n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["pair", "n"])


def learn_bigrams(docs: DataFrame, text: str = "text") -> Bigrams:
    """Counted over all records; the alphabet bounds the table (1.5 million pairs at most)."""
    parts = docs.select(F.col(text)).where(f"length({text}) > 1").mapInArrow(_bigrams, "pair long, n long")
    rows = parts.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    letters = _lookups()[3]
    pairs = {}
    for p, n in zip(rows["pair"].to_pylist(), rows["n"].to_pylist()):
        a, b = letters[p // len(letters)], letters[p % len(letters)]
        if a and b:
            pairs[chr(a), chr(b)] = n
    return Bigrams(pairs)


LOOK_ALIKE = str.maketrans({a: b for own, latin in SCRIPTS for a, b in zip(own, latin)})


@lru_cache(65536)
def plain(run: str) -> str:
    """The run with compatibility forms and look-alike letters replaced: such differences are not garbling."""
    return unicodedata.normalize("NFKC", run).translate(LOOK_ALIKE)


def readings(left: str, run: str, right: str, model: Bigrams) -> list[tuple[int, int, str]]:
    """(swap, log-likelihood gain in whole nats, deciphered run), best first, KEPT at most, one per deciphered form."""
    base, seen, out = max(model.score(left, run, right), model.score(left, plain(run), right)), {run}, []
    for w in (*SHOWN, *SHOWN_WIDE):
        got, back = run, None
        for _ in range(DEPTH):
            got = from_utf8(got, w)
            if got is None:
                break
            back = got
            if got in seen:
                continue
            seen.add(got)
            out.append((model.score(left, got, right) - base, NUMBER[f"utf-8 shown as {w}"], got))
        if back is not None and w in ("cp1252", "latin_1"):  # two readings in two pages that are taken for each other
            other = from_utf8(back, "latin_1" if w == "cp1252" else "cp1252")
            if other is not None and other not in seen:
                seen.add(other)
                out.append((model.score(left, other, right) - base, NUMBER[f"utf-8 shown as {w}"], other))
    for w in SHOWN if max((x[0] for x in out), default=0.0) < SURE else ():
        back = page(w)[0]
        if any(c in back for c in run):
            for r in WRITTEN:
                swap = f"{r} shown as {w}"
                if swap in NUMBER and (got := run.translate(letter_table(w, r))) not in seen:
                    seen.add(got)
                    out.append((model.score(left, got, right) - base, NUMBER[swap], got))
    if LOST in run:
        guess = "".join(c if c != LOST else model.letter(run[k - 1] if k else left, run[k + 1] if k + 1 < len(run) else right) for k, c in enumerate(run))
        out.append((model.score(left, guess, right) - base, NUMBER["bytes lost"], run))
    out.sort(key=lambda x: (-x[0], x[1]))
    shift = max(0.0, out[0][0] - CLIP) if out else 0.0  # the best counts CLIP at most, the others keep their distance
    least = max(FAINT, out[0][0] - shift - 12) if out else 0.0  # what is fainter has no part in any posterior
    return [(swap, round(gain - shift), got) for gain, swap, got in out[:KEPT] if gain - shift >= least]


class Reader:
    """The readings of runs, kept per worker: the same run between the same letters is met again and again."""

    def __init__(self, model: Bigrams) -> None:
        self.model, self.known = model, {}

    def __call__(self, left: str, run: str, right: str) -> list[tuple[int, int, str]]:
        key = (left, run, right)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = [] if self.model.usual(left, run, right) else readings(left, run, right, self.model)
        return got


# General punctuation that code pages have where others have letters; the apostrophe U+2019 is usual between letters
QUOTES = [*range(0x2010, 0x2019), *range(0x201A, 0x2020), *range(0x2024, 0x2028)]
LOW = [0x201A, 0x201E]  # no text has them behind a letter


@lru_cache(1)
def _between() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(general punctuation, low quotes, letters) by code point."""
    quote, low, letter = (np.zeros(0x110000, bool) for _ in range(3))
    quote[QUOTES], low[LOW] = True, True
    for cp in range(0x41, 0xD800):
        letter[cp] = unicodedata.category(chr(cp))[0] == "L"
    return quote, low, letter


def worth_a_look(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The marked characters, and quotes, dashes and ellipses with a letter on both sides or low quotes behind one."""
    hit = _lookups()[2][points]
    quote, low, letter = _between()
    at = np.flatnonzero(quote[points])
    if len(at):
        row = row_index(off)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(points) - 1)
        left = letter[points[before]] & (before < at) & (row[before] == row[at])
        right = letter[points[after]] & (after > at) & (row[after] == row[at])
        hit[at[left & (right | low[points[at]])]] = True
    return hit


def suspicious_rows(column: pa.Array) -> np.ndarray:
    points, off = codepoints_of(column)
    return np.flatnonzero(np.bincount(row_index(off)[worth_a_look(points, off)], minlength=len(off) - 1))


def runs(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, character before, run, character behind) of the runs worth a look."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    look = worth_a_look(points, np.array([0, len(points)]))
    for m in RUN.finditer(text):
        run = m.group()
        if look[m.start() : m.end()].any():
            yield m.start(), m.end(), text[m.start() - 1] if m.start() else "\n", run, text[m.end()] if m.end() < len(text) else "\n"


def _evidence(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    read, counts = Reader(model.value), Counter()
    for batch in batches:
        rows = suspicious_rows(batch.column(1))
        sources, texts = batch.column(0).take(pa.array(rows)).to_pylist(), batch.column(1).take(pa.array(rows)).to_pylist()
        for source, text in zip(sources, texts):
            for *_, left, run, right in runs(text):
                flat = [x for swap, gain, _ in read(left, run, right) for x in (swap, gain)]
                counts[(source, *flat, *[0] * (2 * KEPT - len(flat)))] += 1
    columns = list(zip(*counts)) or [[]] * (1 + 2 * KEPT)
    names = ["source", *(f"{x}{k}" for k in range(KEPT) for x in ("swap", "gain"))]
    yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.int32()) for c in columns[1:]), pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])


def learn_swaps(docs: DataFrame, model, source: str = "source", text: str = "text") -> dict[str, np.ndarray]:
    """{source: log prior of each swap} by expectation-maximization; "" is the mean of all, for sources without own runs."""
    fields = ", ".join(f"swap{k} int, gain{k} int" for k in range(KEPT))
    given = docs.select(F.col(source), F.col(text)).where(f"length({text}) > 0")
    parts = given.mapInArrow(lambda it: _evidence(it, model), f"source string, {fields}, n long")
    keys = ["source", *(f"{x}{k}" for k in range(KEPT) for x in ("swap", "gain"))]
    rows = parts.groupBy(*keys).agg(F.sum("n").alias("n")).toArrow().to_pylist()
    names = sorted({r["source"] for r in rows})
    at = {s: i for i, s in enumerate(names)}
    who = np.array([at[r["source"]] for r in rows], int)
    swap = np.array([[0, *(r[f"swap{k}"] for k in range(KEPT))] for r in rows], int).reshape(-1, KEPT + 1)
    gain = np.array([[0, *(r[f"gain{k}"] if r[f"swap{k}"] else -np.inf for k in range(KEPT))] for r in rows], float).reshape(-1, KEPT + 1)
    n = np.array([r["n"] for r in rows], float)
    states = len(SWAPS) + 1
    common = np.full(states, 0.05 / len(SWAPS))
    common[0] = 0.95
    prior = np.tile(common, (len(names), 1))
    for _ in range(ROUNDS):
        weight = prior[who[:, None], swap] * np.exp(gain)
        share = weight / weight.sum(1, keepdims=True) * n[:, None]
        mass = np.zeros((len(names), states))
        np.add.at(mass, (np.repeat(who, KEPT + 1), swap.ravel()), share.ravel())
        total = mass.sum(0) + 1e-3
        common = total / total.sum()
        prior = (mass + STRENGTH * common) / (mass.sum(1, keepdims=True) + STRENGTH)
    with np.errstate(divide="ignore"):
        learned = {s: np.log(prior[i]) for s, i in at.items()}
        return learned | {"": np.log(common)}


def decide(found: list[tuple[int, int, str]], prior: np.ndarray) -> tuple[float, int, str | None]:
    """(posterior that the run is garbled, swap, deciphered run)."""
    if not found:
        return 0.0, 0, None
    weights = [math.exp(prior[0])] + [math.exp(prior[swap] + gain) for swap, gain, _ in found]
    best = max(range(len(found)), key=lambda k: weights[k + 1])
    return 1 - weights[0] / sum(weights), found[best][0], found[best][2]


def unexplained(read: Reader, left: str, run: str, right: str) -> bool:
    """Whether a run may stand for a letter of an unknown page: behind a letter, short, unusual, explained by no page, and
    with a sign in it that is no letter or space (lone ones and general punctuation only count in front of a letter)."""
    if len(run) > UNIT or LOST in run or not left.isalpha():
        return False
    signs = [c for c in run if unicodedata.category(c)[0] not in "LMZ" and (right.isalpha() or len(run) > 1 and not 0x2010 <= ord(c) < 0x2028)]
    return bool(signs) and not read.model.usual(left, run, right) and all(gain < WEIGHED for _, gain, _ in read(left, run, right))


def _contexts(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    read, counts = Reader(model.value), Counter()
    for batch in batches:
        rows = suspicious_rows(batch.column(1))
        sources, texts = batch.column(0).take(pa.array(rows)).to_pylist(), batch.column(1).take(pa.array(rows)).to_pylist()
        for source, text in zip(sources, texts):
            for *_, left, run, right in runs(text):
                if unexplained(read, left, run, right):
                    counts[source, left, run, right] += 1
    columns = list(zip(*counts)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in columns), pa.array(list(counts.values()), pa.int64())], names=["source", "left", "run", "right", "n"])


class Letters:
    """What each source's unexplained runs stand for: the share of runs that are garbled, and P(run | letter)."""

    def __init__(self, rows: list[dict], model: Bigrams) -> None:
        """By expectation-maximization. A run is as it stands, or its source's cipher wrote it for a letter that the bigrams
        make likely between its neighbours; sources lean on the mean of all."""
        self.letters = [c for c in model.beyond if unicodedata.category(c)[0] == "L"]
        units, sources = sorted({r["run"] for r in rows}), sorted({r["source"] for r in rows})
        self.unit, self.source = {u: k for k, u in enumerate(units)}, {s: k for k, s in enumerate(sources)}
        self.share, self.theta = np.zeros(len(sources)), np.zeros((len(sources), len(self.letters), len(units)))
        if not rows or not self.letters:
            return
        n = np.array([r["n"] for r in rows], float)
        who, which = np.array([self.source[r["source"]] for r in rows]), np.array([self.unit[r["run"]] for r in rows])
        gain = np.array([self.gains(model, r["left"], r["run"], r["right"]) for r in rows])
        common, share = np.full((len(self.letters), len(units)), 1 / len(units)), np.full(len(sources), 0.05)
        theta = np.tile(common, (len(sources), 1, 1))
        for _ in range(LETTER_ROUNDS):
            joint = np.exp(gain) * theta[who, :, which]
            total = joint.sum(1)
            garbled = share[who] * total / (share[who] * total + 1 - share[who])
            mass = np.zeros_like(theta)
            np.add.at(mass, (who, slice(None), which), joint * (garbled * n / np.maximum(total, 1e-300))[:, None])
            whole = mass.sum(0) + 0.5 / len(units)
            common = whole / whole.sum(1, keepdims=True)
            theta = mass + LETTER_STRENGTH * common
            theta /= theta.sum(2, keepdims=True)
            mean = (garbled * n).sum() / n.sum()
            share = (np.bincount(who, garbled * n, len(sources)) + LETTER_STRENGTH * mean) / (np.bincount(who, n, len(sources)) + LETTER_STRENGTH)
        self.share, self.theta = share, theta

    def gains(self, model: Bigrams, left: str, run: str, right: str) -> np.ndarray:
        """For each letter the nats by which it is likelier between its neighbours than the run as it stands."""
        base = max(model.score(left, run, right), model.score(left, plain(run), right))
        gain = np.array([model.log(left, c) + model.log(c, right) for c in self.letters]) - base
        return gain - max(0.0, gain.max() - CLIP)  # the best counts CLIP at most, the others keep their distance

    def read(self, model: Bigrams, source: str, left: str, run: str, right: str) -> tuple[float, str]:
        """(posterior that the run is garbled, letter)."""
        s, u = self.source.get(source), self.unit.get(run)
        if s is None or u is None or not self.letters:
            return 0.0, run
        joint = np.exp(self.gains(model, left, run, right)) * self.theta[s, :, u]
        weight = self.share[s] * joint.sum()
        return weight / (weight + 1 - self.share[s]), self.letters[int(joint.argmax())]


def learn_letters(docs: DataFrame, model, source: str = "source", text: str = "text") -> Letters:
    """From the contexts of all unexplained runs (left, run, right): bounded by the registry and the signs in use."""
    given = docs.select(F.col(source), F.col(text)).where(f"length({text}) > 0")
    parts = given.mapInArrow(lambda it: _contexts(it, model), "source string, left string, run string, right string, n long")
    rows = parts.groupBy("source", "left", "run", "right").agg(F.sum("n").alias("n")).orderBy("source", "left", "run", "right").toArrow().to_pylist()
    return Letters(rows, model.value)


def _restore(batches: Iterator[pa.RecordBatch], model, priors, letters) -> Iterator[pa.RecordBatch]:
    read, known, ciphers = Reader(model.value), priors.value, letters.value
    for batch in batches:
        names = batch.schema.names
        rows = suspicious_rows(batch.column(names.index("text")))
        part = batch.take(pa.array(rows))
        out = defaultdict(list)
        for k, (source, text) in enumerate(zip(part.column(names.index("source")).to_pylist(), part.column(names.index("text")).to_pylist())):
            prior, pieces, at, swaps, worst = known.get(source, known[""]), [], 0, Counter(), 0.0
            for start, end, left, run, right in runs(text):
                sure, swap, got = decide(read(left, run, right), prior)
                name = SWAPS[swap - 1]
                if sure < 0.5 and unexplained(read, left, run, right):
                    name, (sure, got) = UNKNOWN, ciphers.read(model.value, source, left, run, right)
                if sure >= (LONE if name == UNKNOWN else 0.5):
                    worst = max(worst, sure)
                    swaps[name] += 1
                    pieces += [text[at:start], got]
                    at = end
            if worst < LONE and sum(swaps.values()) == 1:
                swaps.clear()
            if swaps:
                restored = "".join([*pieces, text[at:]])
                out["row"].append(k)
                out["restored"].append(restored)
                out["swap"].append(min(swaps, key=lambda s: (-swaps[s], s)) if swaps else None)
                out["runs"].append(sum(swaps.values()))
                out["lost"].append(restored.count(LOST))
                out["sure"].append(worst)
        found = part.take(pa.array(out["row"], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [found.column(names.index("doc_id")), found.column(names.index("source")), pa.array(out["restored"], pa.string()), pa.array(out["swap"], pa.string()), pa.array(out["runs"], pa.int32()), pa.array(out["lost"], pa.int32()), pa.array(out["sure"], pa.float64())],
            names=["doc_id", "source", "restored", "swap", "runs", "lost", "probability"],
        )


def source_of(name: Column, entries: DataFrame | None) -> Column:
    """The entry's spelling in the registry's form; sources that are not registered share "(other)" and null "(none)"."""
    form = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))
    if entries is None:
        return F.coalesce(form, F.lit("(none)"))
    known = [r[0].strip().lower().replace("_", "-") for r in few(entries.select("name").where("name is not null").distinct(), ENTRIES, "registered entries")]
    return F.when(name.isNull(), "(none)").when(form.isin(known), form).otherwise("(other)")


def garbled_records(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """One row per delivered garbled record: doc_id, source, restored text, the swap most of its runs had, the number of
    garbled runs, the characters that stay lost, and the greatest posterior.

    ``docs`` needs doc_id, text and name; extra columns are ignored. Null or empty texts are not garbled. ``entries``
    is the registry (bounded); without it each spelling of a name is a source of its own.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), source_of(F.col("name"), entries).alias("source"), "text").where("doc_id is not null and length(text) > 0")
    model = spark.sparkContext.broadcast(learn_bigrams(given))
    priors = spark.sparkContext.broadcast(learn_swaps(given, model))
    letters = spark.sparkContext.broadcast(learn_letters(given, model))
    return given.mapInArrow(lambda it: _restore(it, model, priors, letters), "doc_id string, source string, restored string, swap string, runs int, lost int, probability double")
