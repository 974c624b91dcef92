"""Encoding and decoding with a frozen slot vocabulary.

A slot with merges is encoded by them, the first learned first; any other by the path of pieces with the greatest
total weight. A character that no piece of the slot covers becomes its UTF-8 bytes in the catch-all slot. Nothing is
lost. The vocabulary is bounded by the id space and is broadcast; runs that repeat in a task are encoded once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import CATCHALL
from ..functions.text import utf8_bytes
from ..session import few
from . import segment
from .slots import LIMIT, SPECIALS

WORD = re.compile(" [^ ]*|[^ ]+")
UNSCORED = -20.0  # weight of a piece that has none
SLOT_SEP = "<|slot_sep|>"  # fixed value: the special between runs of different slots


@dataclass
class Vocabulary:
    """Pieces of each slot with id and weight, the first byte id, and the text or byte of each id."""

    pieces: dict[str, dict[str, tuple[int, float]]]
    longest: dict[str, int]
    first_byte: int
    texts: list[str | int | None]  # a byte where the id stands for one, None for specials
    apart: set[str]  # slots none of whose pieces has a space but at its start: there each space starts a piece
    merges: dict[str, dict[tuple[str, str], int]] = field(default_factory=dict)  # rank of each merge
    specials: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, vocab: DataFrame, merges: DataFrame | None = None) -> Vocabulary:
        rows = vocab.select("id", "slot", "token", "score").orderBy("id").collect()  # a vocabulary: bounded by its ids
        pieces: dict[str, dict[str, tuple[int, float]]] = {}
        texts: list[str | int | None] = [None] * (max((r["id"] for r in rows), default=-1) + 1)
        first = min((r["id"] for r in rows if r["slot"] == CATCHALL), default=len(texts))
        specials = [r["token"] for r in rows if r["slot"] is None]
        for r in rows:
            if r["slot"] == CATCHALL:
                texts[r["id"]] = int(r["token"][3:5], 16)
            elif r["slot"] is not None:
                texts[r["id"]] = r["token"]
                score = r["score"] if r["score"] is not None and r["score"] == r["score"] else UNSCORED
                pieces.setdefault(r["slot"], {}).setdefault(r["token"], (r["id"], score))
        apart = {s for s, p in pieces.items() if not any(" " in t[1:] for t in p)}
        ranks: dict[str, dict[tuple[str, str], int]] = {}
        for r in merges.orderBy("slot", "rank").collect() if merges is not None else ():  # bounded as the vocabulary is
            if r["left"] + r["right"] in pieces.get(r["slot"], {}):
                ranks.setdefault(r["slot"], {}).setdefault((r["left"], r["right"]), r["rank"])
        return cls(pieces, {s: max(map(len, p)) for s, p in pieces.items()}, first, texts, apart, ranks, specials)

    def parts(self, slot: str, text: str) -> list[str]:
        """Spans of a run that can be encoded one by one without changing the best path: words with the space before."""
        return WORD.findall(text) if slot in self.apart else [text]

    def encode(self, slot: str, text: str) -> list[int]:
        """The ids of a run, by the slot's merges or the best path over its pieces; uncovered characters as bytes."""
        if slot in self.merges:
            own = self.pieces[slot]
            return [i for p in merged(text, self.merges[slot]) for i in ([own[p][0]] if p in own else [self.first_byte + b for b in p.encode()])]
        own, longest = self.pieces.get(slot, {}), self.longest.get(slot, 0)
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
        for end in range(1, len(text) + 1):
            top = (best[end - 1][0] - 100.0, end - 1, None)
            for start in range(max(0, end - longest), end):
                hit = own.get(text[start:end])
                if hit is not None and best[start][0] + hit[1] > top[0]:
                    top = (best[start][0] + hit[1], start, hit[0])
            best.append(top)
        ids: list[int] = []
        at = len(text)
        while at:
            _, start, piece = best[at]
            ids += [piece] if piece is not None else [self.first_byte + b for b in reversed(text[start:at].encode())]
            at = start
        ids.reverse()
        return ids

    def decode(self, ids: list[int], specials: bool = False) -> str:
        """The text of ids; specials are skipped or, if asked for, written as their tokens (a slot marker never is). An id
        outside the vocabulary is an error, broken bytes become U+FFFD."""
        out: list[bytes] = []
        for i in ids:
            if not 0 <= i < len(self.texts):
                raise ValueError(f"id {i} outside the vocabulary of {len(self.texts)}")
            piece = self.texts[i]
            if piece is not None:
                out.append(bytes([piece]) if isinstance(piece, int) else piece.encode())
            elif specials and self.specials[i] != SLOT_SEP:
                out.append(self.specials[i].encode())
        return b"".join(out).decode("utf-8", "replace")


def merged(text: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a text after all merges, the least rank first and of equal ones the leftmost."""
    pieces: list[str | None] = list(text)
    after = list(range(1, len(pieces) + 1))
    before = list(range(-1, len(pieces) - 1))
    heap = [(ranks[p], k) for k, p in enumerate(zip(text, text[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        right = after[k]
        if pieces[k] is None or right >= len(pieces) or ranks.get((pieces[k], pieces[right])) != rank:
            continue
        pieces[k] += pieces[right]
        pieces[right] = None
        after[k] = after[right]
        if after[k] < len(pieces):
            before[after[k]] = k
            if (r := ranks.get((pieces[k], pieces[after[k]]))) is not None:
                heapq.heappush(heap, (r, k))
        if before[k] >= 0 and (r := ranks.get((pieces[before[k]], pieces[k]))) is not None:
            heapq.heappush(heap, (r, before[k]))
    return [p for p in pieces if p is not None]


def with_marks(found: list[list[int]], slots: list[str], offsets: np.ndarray, mark: int) -> None:
    """Put ``mark`` in front of each run but a row's first whose slot differs from the one before."""
    begins = set(offsets.tolist())
    for k in range(1, len(found)):
        if k not in begins and slots[k] != slots[k - 1]:
            found[k] = [mark, *found[k]]


def encoded_runs(docs: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", mode: str = "leading", merges: DataFrame | None = None, mark: int | None = None) -> DataFrame:
    """One row per document: the keys, ``ids`` of the whole text, and for each run its slot, characters, bytes, tokens and how
    many of them are bytes. With ``mark`` that id stands between runs of different slots. Ids beyond the vocabulary are
    an error."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab, merges))
    if mark is not None and not 0 <= mark < len(shared.value.texts):
        raise ValueError(f"mark {mark} outside the vocabulary")
    cutter = segment.cutter(mode)
    given = docs.select(*keys, F.coalesce(text, F.lit("")).alias("__t"))
    kept = len(keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            for at, part in cutter.parts(batch.column(kept)):
                runs = cutter.cut(part)
                texts = runs.text.to_pylist()
                found = []
                for slot, run in zip(runs.slot.to_pylist(), texts):
                    ids: list[int] = []
                    for piece in own.parts(slot, run):
                        hit = known.get((slot, piece))
                        if hit is None:
                            if len(known) > 200_000:
                                known.clear()
                            hit = known[slot, piece] = own.encode(slot, piece)
                        ids += hit
                    found.append(ids)
                if mark is not None:
                    with_marks(found, runs.slot.to_pylist(), runs.offsets, mark)
                sizes = np.array([len(x) for x in found], np.int64)
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                if len(flat) and flat.max() >= len(own.texts):
                    raise ValueError(f"id {flat.max()} outside the vocabulary of {len(own.texts)}")
                as_bytes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (flat >= own.first_byte) & (flat < own.first_byte + 256), len(sizes))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends[runs.offsets]), pa.array(flat))
                stats = pa.StructArray.from_arrays([runs.slot, pa.array(runs.end - runs.start), pc.binary_length(runs.text), pa.array(sizes.astype(np.int32)), pa.array(as_bytes.astype(np.int32))], ["slot", "chars", "bytes", "tokens", "as_bytes"])
                columns = [batch.column(k).slice(at, len(part)) for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.ListArray.from_arrays(pa.array(runs.offsets.astype(np.int32)), stats)], names=[*batch.schema.names[:kept], "ids", "run_stats"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "ids array<int>, run_stats array<struct<slot:string,chars:int,bytes:int,tokens:int,as_bytes:int>>"])
    return given.mapInArrow(encode, schema)


def encoded_rows(runs: DataFrame, vocab: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """``runs`` (slot, text, ...) with ``ids`` in place of the text: each run by the model of its slot."""
    shared = runs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab, merges))
    kept = [c for c in runs.columns if c not in ("text", "ids")]
    given = runs.select(*kept, "text").where("slot is not null and text is not null")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            slots, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("slot", "text"))
            found = [[i for p in own.parts(s, t) for i in own.encode(s, p)] for s, t in zip(slots, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    types = dict(runs.dtypes)
    return given.mapInArrow(encode, ", ".join([*(f"`{k}` {types[k]}" for k in kept), "ids array<int>"]))


def byte_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the UTF-8 bytes of each text."""
    return docs.where(F.col(text).isNotNull()).select(key, utf8_bytes(F.col(text)).alias("ids"))


class Decoder:
    """Texts of flat id arrays by gathers: each id has a slice of one byte buffer."""

    def __init__(self, vocab: Vocabulary, specials: bool) -> None:
        parts = [b"" if t is None else bytes([t]) if isinstance(t, int) else t.encode() for t in vocab.texts]
        if specials:
            for i, t in enumerate(vocab.specials):
                parts[i] = b"" if t == SLOT_SEP else t.encode()
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: pa.Array) -> pa.Array:
        flat, off = ids.flatten().to_numpy(), pc.list_value_length(ids).fill_null(0).to_numpy()
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(self.size):
            raise ValueError(f"ids from {flat.min()} to {flat.max()} in a vocabulary of {len(self.size)}")
        n = self.size[flat]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = self.bytes[np.repeat(self.start[flat], n) + inner]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(off)])]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
        try:
            texts = out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that break a character, as cut streams have them
            texts = pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def decoded(encoded: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "decoded", specials: bool = False) -> DataFrame:
    """``encoded`` with the text of its ids; ``specials`` as in Vocabulary.decode."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(shared.value, specials)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own(batch.column(batch.schema.get_field_index(ids)))], names=[*batch.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), f"`{out}` string"])
    return encoded.mapInArrow(decode, schema)


def id_groups(streams: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, first_pos, slot, ids): consecutive ids of one slot of each stream (key, ids); specials end a group and are in none.
    Islands on the flat ids of a batch."""
    rows = few(ranges.select("name", "start_id", "end_id").orderBy("start_id"), LIMIT, "slots")
    names = [r["name"] for r in rows]
    first, end = (np.array([r[c] for r in rows], np.int64) for c in ("start_id", "end_id"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())])
            at = np.searchsorted(first, ids, "right") - 1
            slot = np.where((at >= 0) & (ids < end[np.maximum(at, 0)]), at, -1)
            edge = np.ones(len(ids), bool)
            edge[1:] = slot[1:] != slot[:-1]
            edge[off[:-1][off[:-1] < len(ids)]] = True
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(ids)))
            row = np.searchsorted(off, start, "right") - 1
            all_groups = pa.ListArray.from_arrays(pa.array(np.append(start, len(ids)).astype(np.int32)), pa.array(ids)) if len(start) else pa.array([], pa.list_(pa.int32()))
            own = pa.array(np.flatnonzero((slot[start] >= 0) & (size > 0)))
            columns = [batch.column(0).take(pa.array(row)), pa.array((start - off[row]).astype(np.int32)), pa.array(names).take(pa.array(np.maximum(slot[start], 0))), all_groups]
            yield pa.RecordBatch.from_arrays([c.take(own) for c in columns], names=[key, "first_pos", "slot", "ids"])

    return streams.select(key, "ids").mapInArrow(group, f"`{key}` {dict(streams.dtypes)[key]}, first_pos int, slot string, ids array<int>")


def roundtrip(back: DataFrame, wanted: str = "nfc", examples: int = 5, chars: int = 120) -> DataFrame:
    """(documents, exact, failures, total_ids, special_ids, examples) of decoded rows with ids and the text ``wanted``."""
    bad = F.col("decoded").isNull() | (F.col("decoded") != F.col(wanted))
    special = F.size(F.filter("ids", lambda i: i < len(SPECIALS)))
    sums = back.agg(F.count("*").alias("documents"), F.count_if(~bad).alias("exact"), F.count_if(bad).alias("failures"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total_ids"), F.coalesce(F.sum(special), F.lit(0)).alias("special_ids"))
    shown = back.where(bad).select(F.substring(wanted, 1, chars).alias("t")).orderBy("t").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("examples"))
    return sums.crossJoin(shown)
