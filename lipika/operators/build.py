"""Building a tokenizer from documents: budgets, a model for each slot by its own algorithm, ids and layout, gates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..session import few, materialize
from ..sources import sinks
from . import codec, segment, slots, training
from .slots import BYTE_ROWS, DEFAULT_SPECS, SPECIALS, SlotSpec

WORDS = codec.WORD.pattern  # unigram slots are trained on the parts that the encoder takes one by one


def train_slots(runs: DataFrame, budget: Mapping[str, int], specs: Sequence[SlotSpec] = DEFAULT_SPECS) -> tuple[DataFrame, DataFrame]:
    """((slot, token, score), (slot, rank, left, right)): at most ``budget`` pieces of each trained slot that has runs, by the
    slot's algorithm, and the merges of the bpe slots. All slots are trained in the same jobs."""
    spark = runs.sparkSession
    own = {a: [s for s in specs if s.algorithm == a] for a in ("bpe", "unigram")}
    whole = F.col("slot").isin([s.name for s in own["bpe"]])
    parts = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    wanted = runs.where(F.col("slot").isin([s.name for a in own.values() for s in a]))
    counts = materialize(training.run_counts(wanted.select("slot", F.explode(parts).alias("text"))), "counts")
    here = {r["slot"] for r in counts.select("slot").distinct().collect()}
    pieces, merges = [], []
    chars = counts.where(whole).select("slot", "n", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("slot", "c").agg(F.sum("n").alias("n"))
    alphabet: dict[str, list[str]] = {}
    for r in chars.orderBy("slot", F.desc("n"), "c").collect():  # at most all characters there are
        alphabet.setdefault(r["slot"], []).append(r["c"])
    plans = {s.name: training.Merges(budget[s.name], s.max_piece_length) for s in own["bpe"] if s.name in here}
    for slot, plan in (training.bpe(counts, plans) if plans else {}).items():
        made = dict.fromkeys([*alphabet[slot][: plan.size], *(a + b for a, b, _ in plan.found)])
        tokens = list(made)[: plan.size]
        pieces += [(slot, t, -math.log(len(tokens))) for t in tokens]
        merges += [(slot, k, a, b) for k, (a, b, _) in enumerate(plan.found) if a + b in set(tokens)]
    sizes = {s.name: (budget[s.name], s.max_piece_length) for s in own["unigram"] if s.name in here}
    for slot, found in (training.unigram(counts, sizes) if sizes else {}).items():
        pieces += [(slot, t, w) for t, w in found.items()]
    return spark.createDataFrame(pieces, "slot string, token string, score double"), spark.createDataFrame(merges, "slot string, rank int, left string, right string")


def slot_pieces(runs: DataFrame, budget: Mapping[str, int], specs: Sequence[SlotSpec] = DEFAULT_SPECS) -> DataFrame:
    """(slot, token, score): the pieces of train_slots."""
    return train_slots(runs, budget, specs)[0]


def assemble(pieces: DataFrame, specs: Sequence[SlotSpec] = DEFAULT_SPECS) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, layout): specials, the pieces of each slot in the order of the specifications, the byte rows.

    A trained slot without pieces is an error: its scripts have no corpus.
    """
    found: dict[str, list] = {}
    for r in pieces.orderBy("slot", F.desc("score"), "token").collect():  # bounded by the budgets
        found.setdefault(r["slot"], []).append((r["token"], r["score"]))
    rows: list[tuple] = [(k, None, None, s, None) for k, s in enumerate(SPECIALS)]
    sizes = []
    for k, s in enumerate(specs):
        own = [(f"<0x{b:02X}>", None) for b in range(BYTE_ROWS)] if s.algorithm == "bytes" else found.get(s.name, [])
        if not own:
            raise ValueError(f"slot {s.name} has no corpus")
        sizes.append((s.name, s.algorithm, len(own), k))
        rows += [(len(rows) + i, s.name, i, token, score) for i, (token, score) in enumerate(own)]
    spark = pieces.sparkSession
    vocab = spark.createDataFrame(rows, "id int, slot string, local_id int, token string, score double")
    return vocab, slots.layout(spark.createDataFrame(sizes, "name string, algorithm string, size int, ord int"))


@dataclass
class Built:
    vocab: DataFrame
    ranges: DataFrame
    merges: DataFrame
    budget: dict[str, int]
    specs: Sequence[SlotSpec]


def train(docs: DataFrame, total: int, mode: str = "leading", specs: Sequence[SlotSpec] = DEFAULT_SPECS, **options) -> Built:
    """Vocabulary, layout, merges and budgets of documents with doc_id and text; ``options`` go to slots.allocate."""
    slots.validate(specs)
    runs = materialize(segment.runs(docs, mode=mode, slot_map=slots.slot_map(specs)).select("slot", "text"), "runs")
    sizes = few(runs.groupBy("slot").agg(F.sum(F.octet_length("text")).alias("bytes")), slots.LIMIT, "slots")
    budget = slots.allocate({r["slot"]: r["bytes"] for r in sizes}, total, specs, **options)
    pieces, merges = train_slots(runs, budget, specs)
    return Built(*assemble(pieces, specs), merges, budget, specs)


def gates(docs: DataFrame, path: str, mode: str = "leading") -> DataFrame:
    """(gate, passed) of a frozen tokenizer, as read back: texts and adversarial strings come back exactly, every id has a slot,
    the layout is sound, files are as frozen."""
    from ..model import TokenizerModel

    spark = docs.sparkSession
    model = TokenizerModel.load(spark, path, mode)
    hard = spark.createDataFrame([(t,) for t in ADVERSARIAL], "t string").select(scripts.nfc(F.col("t")).alias("nfc"))
    given = docs.where("text is not null").select(scripts.nfc(F.col("text")).alias("nfc")).unionByName(hard)
    back = model.decode(model.encode(given, ("nfc",), "nfc"))
    failed = [
        ("roundtrip", back.where("decoded <> nfc")),
        ("id_space", slots.unrouted(model.ranges)),
        ("layout", slots.violations(model.ranges)),
        ("manifest", sinks.verify(spark, path)),
    ]
    return spark.createDataFrame([(name, not df.take(1)) for name, df in failed], "gate string, passed boolean")


def report(docs: DataFrame, built: Built, checked: DataFrame, mode: str = "leading") -> dict:
    """What a build made, as plain values: sizes, budgets, layout, corpus metrics, slot metrics and gates."""
    encoded = materialize(codec.encoded_runs(docs.where("text is not null"), built.vocab, mode=mode, merges=built.merges), "encoded")
    stats = encoded.select(F.inline("run_stats")).groupBy("slot").agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in ("chars", "bytes", "tokens", "as_bytes")))
    rows = {r["slot"]: r.asDict() for r in stats.collect()}
    per_slot = {s: r | {"tokens_per_char": rounded(r["tokens"], r["chars"]), "bytes_per_token": rounded(r["bytes"], r["tokens"])} for s, r in sorted(rows.items())}
    words = docs.where("text is not null").agg(F.count("*").alias("documents"), F.sum(F.size(F.filter(F.split("text", text.WORD_SPACE + "+"), lambda w: w != ""))).alias("words")).first()
    tokens, chars = (sum(r[c] for r in rows.values()) for c in ("tokens", "chars"))
    ranges = [r.asDict() for r in built.ranges.orderBy("start_id").collect()]
    size = max(r["end_id"] for r in ranges)
    return {
        "vocab_size": size,
        "padded_vocab_size": -(-size // slots.MULTIPLE) * slots.MULTIPLE,
        "budget": built.budget,
        "layout": ranges,
        "corpus": {"documents": words["documents"], "words": words["words"], "tokens": tokens, "chars": chars, "tokens_per_word": rounded(tokens, words["words"]), "tokens_per_char": rounded(tokens, chars)},
        "slots": per_slot,
        "gates": {r["gate"]: r["passed"] for r in checked.collect()},
    }


def rounded(a: float, b: float) -> float | None:
    """a / b to four places; None where b is 0."""
    return round(a / b, 4) if b else None


# Strings on which tokenizers fail, of our own choice: nothing, spaces, joiners, stacked marks, many scripts, open and closed spans.
ADVERSARIAL = ("", " ", " \n\t ", "क्\u200dष क्\u200cष", "a" + "\u0301" * 9, "👩\u200d🔧 🏳️\u200d🌈", "русский ελληνικά עברית العربية 中文 日本語 한국어 ไทย தமிழ் বাংলা", "```py\nx = 1\n``` $x^2$ \\[y\\]", "``` open $ ` \\(", "a" * 2000, "\x00\x01\x7f\x85", "ﬁ ½ ² ª º", "x\r\ny\rz", "<pad> <bos> <0x41> <|slot_sep|>", "\ufeff\u00a0\u2003|", "ಕನ್ನಡ पाठ mix १२३")
