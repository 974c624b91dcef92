"""The queries of the core engine: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..operators import build, codec, compare, corpus, generator, segment, slots, training
from ..operators.prefix import with_before, with_number
from ..model import TokenizerModel
from ..session import few, fresh_path, materialize, table
from ..sources import sinks
from ..sources.files import read_documents, read_slot_corpus
from .registry import QUERIES, Query, docs, given, joined, query, spread

GROUPED = {"COMMON": "NEUTRAL", "LATIN": "EUROPEAN", "GREEK": "EUROPEAN", "CYRILLIC": "EUROPEAN", "DEVANAGARI": "INDIC", "KANNADA": "INDIC"}


def queries() -> dict[str, Query]:
    from . import evaluation  # noqa: F401  its queries register themselves

    return dict(QUERIES)


# --- scans and extraction -------------------------------------------------------------------------------------
@query
def scan_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "kind", F.length("text").cast("long").alias("chars"))


@query
def read_slot_partition(spark, sf):
    path = fresh_path(spark, "slots")
    sinks.write_slot_corpus(segment.runs(docs(spark, sf)), path)
    return read_slot_corpus(spark, path, "KANNADA").agg(F.count("*").alias("runs"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def loose_jsonl_text(spark, sf):
    """Lines of every kind, made of the documents: objects under several keys, broken ones, plain text, blanks."""
    t = F.col("text")
    line = F.concat(F.lit('{"'), F.element_at(F.array(*map(F.lit, ("text", "content", "target", "other"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit('": '), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit("}"))
    lines = given(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 == 5, F.concat(F.lit("  "), t, F.lit(" "))).when(F.col("doc_id") % 7 == 6, F.lit("{broken}")).otherwise(line).alias("line"))
    return lines.withColumn("text", corpus.loose_text(F.col("line"))).where("text is not null").select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query
def extract_text_filtered(spark, sf):
    return corpus.extract(given(spark, sf), 200, 1000).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query
def group_first_seen(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("documents"))


@query
def concat_string_fields(spark, sf):
    fields = [F.trim(c) for c in ("kind", "lang", "source")]
    return docs(spark, sf).select("doc_id", F.concat_ws(" ", *fields).alias("joined")).where("length(joined) >= 20")


@query
def sample_by_char_budget(spark, sf):
    sized = given(spark, sf).select("doc_id", "lang", F.length("text").alias("n"))
    cut = corpus.running_cut(sized, F.col("n"), 20_000, ["doc_id"], ["lang"])
    return cut.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


@query
def char_cap_take(spark, sf):
    sized = given(spark, sf).select("doc_id", F.length("text").cast("long").alias("chars"))
    return corpus.running_cut(sized, F.col("chars"), 200_000, ["doc_id"])


@query
def limit_docs(spark, sf):
    return docs(spark, sf).orderBy("doc_id").limit(50).select("doc_id", "kind")


@query
def heldout_word_shuffle(spark, sf):
    return corpus.heldout_by_shuffle(docs(spark, sf), 9999).select("doc_id", "kind", F.md5("text").alias("digest"))


@query
def positional_split(spark, sf):
    return corpus.positional_split(docs(spark, sf).select("doc_id", "lang"), 0.15, ["doc_id"], ["lang"]).groupBy("lang", "part").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


@query
def seeded_shuffle(spark, sf):
    keyed = docs(spark, sf).select("doc_id", "kind", corpus.seeded_key("doc_id", seed=1337).alias("key"))
    return with_number(keyed, ["key", "doc_id"], ["kind"], "place").select("doc_id", "kind", "place")


@query
def sentence_overlap(spark, sf):
    d = table(spark, sf, "corpus_docs")
    return corpus.sentence_overlap(d.where("split = 'train'"), d.where("split = 'test'"))


# --- segmentation ----------------------------------------------------------------------------------------------
@query
def slot_corpus_bytes(spark, sf):
    return segment.runs(docs(spark, sf)).groupBy("slot").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def segment_leading(spark, sf):
    return segment.runs(docs(spark, sf))


@query
def segment_neutral(spark, sf):
    return segment.runs(docs(spark, sf), mode="neutral")


@query
def segment_grouped(spark, sf):
    return segment.runs(docs(spark, sf), slot_map=GROUPED).select("doc_id", "run_pos", "slot", "start", "end")


@query
def runs_exploded(spark, sf):
    return segment.runs(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("runs"), F.max("end").alias("chars"))


@query
def runs_by_slot(spark, sf):
    return segment.runs(docs(spark, sf)).where("slot = 'DEVANAGARI'").select("doc_id", "run_pos", "text")


@query
def structural_spans(spark, sf):
    spans = scripts.structural_spans(scripts.nfc(F.col("text")))
    return given(spark, sf).select("doc_id", F.posexplode(spans).alias("pos", "span"))


@query
def char_script_histogram(spark, sf):
    return segment.script_counts(given(spark, sf))


@query
def char_slot_histogram(spark, sf):
    """Script counts by slot; marks and joiners keep INHERITED, scripts without a slot go to CATCHALL."""
    names = scripts.DEFAULT_SLOT_MAP | {scripts.INHERITED: scripts.INHERITED}
    slot = F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("script")], F.lit(scripts.CATCHALL))
    return segment.script_counts(given(spark, sf)).groupBy(slot.alias("slot")).agg(F.sum("chars").alias("chars"))


@query
def nfc_normalize(spark, sf):
    d = spread(table(spark, sf, "corpus_docs")).where("text is not null")
    return d.select("doc_id", F.md5(scripts.nfc(F.col("text"))).alias("digest")).distinct()


@query
def dominant_slot(spark, sf):
    return _dominant(spark, sf).select("doc_id", "slot", "purity")


def _dominant(spark, sf) -> DataFrame:
    """(doc_id, slot, purity): the slot with the most characters besides NEUTRAL; of equal ones the first in the text."""
    per = segment.runs(docs(spark, sf)).where("slot <> 'NEUTRAL'").groupBy("doc_id", "slot").agg(F.sum(F.length("text")).alias("n"), F.min("run_pos").alias("first"))
    top = per.groupBy("doc_id").agg(F.max_by("slot", F.struct("n", -F.col("first"))).alias("slot"), F.max("n").alias("n"), F.sum("n").alias("all"))
    found = top.select("doc_id", "slot", F.expr("100 * n div all").cast("long").alias("purity"))
    return given(spark, sf).select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("slot", F.lit("NEUTRAL")).alias("slot"), F.coalesce("purity", F.lit(0)).alias("purity"))


@query
def pure_documents(spark, sf):
    return _dominant(spark, sf).where("slot <> 'NEUTRAL' and purity >= 90").groupBy("slot").agg(F.count("*").alias("documents"))


@query
def balance_by_script(spark, sf):
    pure = _dominant(spark, sf).where("slot <> 'NEUTRAL' and purity >= 90").join(given(spark, sf).select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id")
    pure = materialize(pure.withColumn("key", corpus.seeded_key("doc_id", seed=1337)), "pure")
    target = pure.groupBy("slot").agg(F.sum("bytes").alias("b")).agg(F.min("b").alias("target"))
    cut = corpus.running_cut(pure.crossJoin(F.broadcast(target)), F.col("bytes"), F.col("target"), ["key", "doc_id"], ["slot"])
    return cut.select("doc_id", "slot", "bytes")


@query
def whitespace_mode_cost(spark, sf):
    both = [segment.runs(docs(spark, sf), mode=m).groupBy("slot").agg(F.count("*").alias(f"{m}_runs"), F.sum(F.length("text")).alias(f"{m}_chars")) for m in ("leading", "neutral")]
    return both[0].join(both[1], "slot", "full").select("slot", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leading_runs", "leading_chars", "neutral_runs", "neutral_chars")))


@query
def slot_markers(spark, sf):
    r = segment.runs(docs(spark, sf))
    return r.groupBy("doc_id").agg((F.count("*") - 1).alias("markers"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_pos", "slot"))), lambda x: x["slot"]), "|").alias("slots"))


@query
def lexical_diversity(spark, sf):
    return segment.runs(docs(spark, sf)).groupBy("slot").agg(F.count("*").alias("runs"), F.countDistinct("text").alias("distinct_runs"), F.sum(F.length("text")).alias("chars"))


# --- scalar functions ------------------------------------------------------------------------------------------
@query
def doc_text_stats(spark, sf):
    t = F.col("text")
    return given(spark, sf).select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), text.word_count(t).cast("long").alias("words"))


@query
def byte_encode(spark, sf):
    return given(spark, sf).select("doc_id", joined(text.utf8_bytes(F.col("text"))).alias("ids"), F.octet_length("text").cast("long").alias("tokens"))


@query
def byte_roundtrip(spark, sf):
    back = text.from_bytes(text.utf8_bytes(F.col("text")))
    return given(spark, sf).select((back == F.col("text")).alias("exact")).groupBy("exact").agg(F.count("*").alias("documents"))


@query
def byte_level_text(spark, sf):
    return given(spark, sf).select("doc_id", F.md5(text.byte_level(F.col("text"))).alias("digest"))


@query
def doc_sha256(spark, sf):
    return given(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query
def lang_benchmark(spark, sf):
    t = F.col("text")
    sums = given(spark, sf).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(text.word_count(t)).alias("words"), F.sum(F.length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"))
    return sums.withColumn("bytes_per_word", text.ratio(F.col("bytes"), F.col("words"))).withColumn("bytes_per_char", text.ratio(F.col("bytes"), F.col("chars")))


@query
def observed_alphabet(spark, sf):
    return given(spark, sf).select(F.explode(F.array_distinct(text.utf8_bytes(F.col("text")))).alias("byte")).groupBy("byte").agg(F.count("*").alias("documents"))


@query
def padded_vocab(spark, sf):
    return table(spark, sf, "slot_ranges").agg(F.max("end_id").cast("long").alias("vocab_size")).select("vocab_size", slots.padded(F.col("vocab_size")).alias("padded_vocab_size"))


@query
def embedding_params(spark, sf):
    size = (F.col("end_id") - F.col("start_id")).cast("long")
    return table(spark, sf, "slot_ranges").select("name", (size * 2048).alias("tied"), (size * 4096).alias("untied"))


# --- layout and vocabulary -------------------------------------------------------------------------------------
@query
def id_layout(spark, sf):
    sizes = table(spark, sf, "slot_ranges").select("name", "algorithm", "size", F.col("start_id").alias("ord"))
    return slots.layout(sizes)


@query
def layout_violations(spark, sf):
    return slots.violations(table(spark, sf, "slot_ranges"))


@query
def id_to_slot(spark, sf):
    ranges = table(spark, sf, "slot_ranges")
    top = ranges.agg(F.max("end_id")).first()[0]
    return slots.with_slot_of_id(spark.range(-2, top + 40).select(F.col("id").cast("int").alias("id")), ranges)


@query
def id_space_sound(spark, sf):
    ranges = table(spark, sf, "slot_ranges")
    top = ranges.agg((F.max("end_id") - len(slots.SPECIALS)).cast("long").alias("ids"))
    return top.crossJoin(slots.unrouted(ranges).agg(F.count("*").alias("unrouted")))


@query
def describe_layout(spark, sf):
    specs = table(spark, sf, "slot_specs").select("name", F.array_join("scripts", ",").alias("scripts"), "structural", "trained")
    return table(spark, sf, "slot_ranges").join(specs, "name").select("name", "start_id", "end_id", "algorithm", "scripts", "structural", "trained")


@query
def vocab_freeze(spark, sf):
    v = table(spark, sf, "slot_vocab").where("slot is not null")
    sizes = v.groupBy("slot").agg(F.count("*").alias("size"), F.min("id").alias("ord")).select(F.col("slot").alias("name"), "size", "ord", F.lit("frozen").alias("algorithm"))
    return slots.layout(sizes)


@query
def local_vocab(spark, sf):
    v = table(spark, sf, "slot_vocab").where("slot is not null")
    return v.select("id", "slot", (F.row_number().over(Window.partitionBy("slot").orderBy("id")) - 1).cast("int").alias("local_id"))


@query
def local_to_global(spark, sf):
    v = table(spark, sf, "slot_vocab").where("slot is not null")
    r = table(spark, sf, "slot_ranges").select(F.col("name").alias("slot"), "start_id")
    return v.join(F.broadcast(r), "slot").select("id", "slot", (F.col("start_id") + F.col("local_id")).cast("int").alias("global_id"))


@query
def token_to_first_id(spark, sf):
    return table(spark, sf, "slot_vocab").groupBy("token").agg(F.min("id").alias("first_id"), F.count("*").alias("ids"))


@query
def byte_tax(spark, sf):
    v = table(spark, sf, "slot_vocab").where("slot is not null")
    raw = F.sum(F.when(F.octet_length("token") == 1, 1).when(F.col("token").rlike("^<0x[0-9A-F]{2}>$"), 1).otherwise(0))
    return v.groupBy("slot").agg(F.count("*").alias("rows"), raw.alias("byte_rows")).withColumn("share", F.col("byte_rows") / F.col("rows"))


# --- token streams of the byte slot ----------------------------------------------------------------------------


def _first_byte(spark, sf) -> int:
    return table(spark, sf, "slot_ranges").where("name = 'CATCHALL'").first()["start_id"]


def _byte_ids(spark, sf) -> DataFrame:
    start = _first_byte(spark, sf)
    return given(spark, sf).where("text <> ''").select("doc_id", "lang", F.transform(text.utf8_bytes(F.col("text")), lambda b: b + F.lit(start)).alias("ids"))


@query
def encode_with_bos_eos(spark, sf):
    ids = F.concat(F.array(F.lit(1)), F.col("ids"), F.array(F.lit(2)))
    return _byte_ids(spark, sf).select("doc_id", F.size(ids).cast("long").alias("tokens"), joined(ids).alias("ids"))


@query
def decode_skip_specials(spark, sf):
    ids = F.filter(F.concat(F.array(F.lit(1)), F.col("ids"), F.array(F.lit(2), F.lit(0))), lambda x: x >= len(slots.SPECIALS))
    start = _first_byte(spark, sf)
    back = text.from_bytes(F.transform(ids, lambda x: x - F.lit(start)))
    return _byte_ids(spark, sf).select("doc_id", F.md5(back).alias("digest"))


@query
def pad_batch(spark, sf):
    """Batches of 32 documents by id, each padded to its longest."""
    base = _byte_ids(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 32)).withColumn("n", F.size("ids"))
    width = F.max("n").over(Window.partitionBy("batch"))
    padded = base.withColumn("width", width).withColumn("all", F.concat("ids", F.array_repeat(F.lit(0), F.col("width") - F.col("n"))))
    return padded.select("doc_id", "batch", F.size("all").cast("long").alias("width"), F.aggregate(F.transform("all", lambda x: (x != 0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))


@query
def lm_windows(spark, sf):
    """Scoring windows of 256 tokens over each document's stream; each but its first token is scored once."""
    n = F.size("ids")
    per = _byte_ids(spark, sf).select("doc_id", n.alias("n")).where("n >= 2").select("doc_id", "n", F.explode(F.expr("sequence(0, n - 2, 256)")).alias("start"))
    return per.select("doc_id", F.col("start").cast("long").alias("start"), (F.least(F.col("start") + 257, F.col("n")) - F.col("start") - 1).cast("long").alias("scored"))


@query
def shard_plan(spark, sf):
    size = F.octet_length("text") + 1
    placed = with_before(given(spark, sf).where("text <> ''").select("doc_id", size.cast("long").alias("n")), F.col("n"), ["doc_id"], out="offset")
    cut = sinks.shard_pieces(placed, F.col("n"), 100_000)
    return cut.groupBy("shard").agg(F.count("*").alias("pieces"), F.sum(F.col("to_offset") - F.col("from_offset")).alias("tokens"))


@query
def bpb_ngram(spark, sf):
    """Bits per byte of a smoothed byte-bigram model fitted on the first half of the documents and scored on the rest."""
    pairs = F.expr("transform(sequence(1, size(b) - 1), i -> struct(b[i - 1] as a, b[i] as b))")
    base = given(spark, sf).select("doc_id", text.utf8_bytes(F.col("text")).alias("b")).where("size(b) >= 2").select((F.col("doc_id") % 2).alias("half"), F.inline(pairs))
    counts = materialize(base.groupBy("half", "a", "b").agg(F.count("*").alias("n")), "bigrams")
    fit = counts.where("half = 0").select("a", "b", F.col("n").alias("k"))
    first = fit.groupBy("a").agg(F.sum("k").alias("all"))
    scored = counts.where("half = 1").join(fit, ["a", "b"], "left").join(first, "a", "left")
    nll = -F.log((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("all", F.lit(0)) + 256)) * F.col("n")
    return scored.agg(F.sum("n").alias("scored_tokens"), F.round(F.sum(nll) / F.log(F.lit(2.0)) / F.sum("n"), 6).alias("bits_per_byte"))


# --- metrics of the byte codec and of the frozen vocabulary ----------------------------------------------------
@query
def per_slot_metrics(spark, sf):
    sums = segment.runs(docs(spark, sf)).groupBy("slot").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    return sums.withColumn("tokens", F.col("bytes")).withColumn("tokens_per_char", text.ratio(F.col("tokens"), F.col("chars"))).withColumn("chars_per_token", text.ratio(F.col("chars"), F.col("tokens"))).withColumn("bytes_per_token", text.ratio(F.col("bytes"), F.col("tokens")))


@query
def corpus_metrics(spark, sf):
    t = F.col("text")
    sums = given(spark, sf).agg(F.count("*").alias("documents"), F.sum(F.octet_length(t)).alias("tokens"), F.sum(F.length(t)).alias("chars"), F.sum(text.word_count(t)).alias("words"))
    return sums.withColumn("tokens_per_word", text.ratio(F.col("tokens"), F.col("words"))).withColumn("tokens_per_char", text.ratio(F.col("tokens"), F.col("chars")))


@query
def roundtrip_report(spark, sf):
    back = text.from_bytes(text.utf8_bytes(F.col("text")))
    return given(spark, sf).agg(F.count("*").alias("documents"), F.count_if(back == F.col("text")).alias("exact"), F.sum(F.octet_length("text")).alias("total_ids")).withColumn("failures", F.col("documents") - F.col("exact"))


@query
def gates(spark, sf):
    back = text.from_bytes(text.utf8_bytes(F.col("text")))
    one = given(spark, sf).agg((F.count_if(back != F.col("text")) == 0).alias("passed")).select(F.lit("roundtrip").alias("gate"), "passed")
    two = id_space_sound(spark, sf).select(F.lit("id_space").alias("gate"), (F.col("unrouted") == 0).alias("passed"))
    three = slots.violations(table(spark, sf, "slot_ranges")).agg((F.count("*") == 0).alias("passed")).select(F.lit("layout").alias("gate"), "passed")
    return one.unionByName(two).unionByName(three)


@query
def bpe_train_pairs(spark, sf):
    return training.first_pairs(training.run_counts(segment.runs(docs(spark, sf))))


@query
def unigram_seed_pieces(spark, sf):
    return training.seed_pieces(training.run_counts(segment.runs(docs(spark, sf)).where("slot = 'KANNADA'")), 3)


@query
def fallback_chars(spark, sf):
    """Characters by slot that have no piece of their own in the slot's vocabulary and would become bytes."""
    single = table(spark, sf, "slot_vocab").where("slot is not null and slot <> 'CATCHALL' and length(token) = 1").select("slot", F.col("token").alias("ch")).distinct()
    found = segment.runs(docs(spark, sf)).select("slot", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("slot", "ch").agg(F.count("*").alias("n"))
    return found.join(single.withColumn("known", F.lit(1)), ["slot", "ch"], "left").groupBy("slot").agg(F.sum("n").alias("chars"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("uncovered"))


@query
def sentence_space(spark, sf):
    """Distinct sentences the grammar of each kind can make: the product of its banks."""
    banks = spark.createDataFrame([(k, n) for k, *sizes in generator.bank_sizes() for n in sizes], "kind string, n long")
    return banks.groupBy("kind").agg(F.round(F.product("n")).cast("long").alias("space"))


@query
def budget_allocation(spark, sf):
    sizes = segment.runs(docs(spark, sf)).groupBy("slot").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return slots.budget_rows(spark, sizes, 8000, least=1, most=64_000)


@query
def synthetic_corpus(spark, sf):
    return generator.documents(spark, 10_000, 1337)


@query
def synthetic_heldout(spark, sf):
    return generator.documents(spark, 2_500, 4242, "held")


# --- trained models and iterative work: rows only --------------------------------------------------------------
@query
def encode_documents(spark, sf):
    found = codec.encoded_runs(docs(spark, sf), table(spark, sf, "slot_vocab"))
    return found.select("doc_id", F.size("ids").cast("long").alias("tokens"), joined(F.col("ids")).alias("ids"))


@query
def encode_stats(spark, sf):
    found = codec.encoded_runs(docs(spark, sf), table(spark, sf, "slot_vocab"))
    stats = found.select(F.inline("run_stats")).groupBy("slot").agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in ("chars", "bytes", "tokens", "as_bytes")))
    return stats.withColumn("tokens_per_char", text.ratio(F.col("tokens"), F.col("chars"))).withColumn("bytes_per_token", text.ratio(F.col("bytes"), F.col("tokens")))


@query
def decode_documents(spark, sf):
    vocab = table(spark, sf, "slot_vocab")
    d = docs(spark, sf).withColumn("nfc", scripts.nfc(F.col("text"))).where("text is not null")
    back = codec.decoded(codec.encoded_runs(d, vocab, ("doc_id", "nfc")), vocab)
    return back.agg(F.count("*").alias("documents"), F.count_if(F.col("decoded") == F.col("nfc")).alias("exact"))


@query
def fired_pieces(spark, sf):
    found = codec.encoded_runs(docs(spark, sf), table(spark, sf, "slot_vocab"))
    used = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return slots.with_slot_of_id(used, table(spark, sf, "slot_ranges")).groupBy("slot").agg(F.count("*").alias("pieces"), F.sum("n").alias("tokens"))


@query
def bpe_train(spark, sf):
    """Every slot whose specification says bpe, as many merges of bytes as its budget has rows."""
    specs, budget, runs = _plan(spark, sf)
    own = [s for s in specs if s.algorithm == "bpe"]
    plans = {s.name: training.Merges(256 + budget[s.name], 1 << 20) for s in own}
    counts = training.run_counts(runs)
    here = {r["slot"] for r in runs.select("slot").distinct().collect()}
    found = training.bpe(counts, {s: p for s, p in plans.items() if s in here}, as_bytes=True)
    rows = [(s, k, x.hex(), y.hex(), n) for s, p in found.items() for k, (x, y, n) in enumerate(p.found)]
    return spark.createDataFrame(rows, "slot string, rank int, left string, right string, n long")


def _plan(spark, sf, total: int = 8000) -> tuple:
    """Specifications, budgets and the runs of the documents, written out."""
    specs = slots.specs_from_rows(r.asDict() for r in few(table(spark, sf, "slot_specs"), slots.LIMIT, "slots"))
    runs = materialize(segment.runs(docs(spark, sf)).select("slot", "text"), "runs")
    sizes = few(runs.groupBy("slot").agg(F.sum(F.octet_length("text")).alias("bytes")), slots.LIMIT, "slots")
    return specs, slots.allocate({r["slot"]: r["bytes"] for r in sizes}, total, specs), runs


@query
def unigram_train(spark, sf):
    """Every slot whose specification says unigram, up to its budget and piece length."""
    specs, budget, runs = _plan(spark, sf)
    return build.slot_pieces(runs, budget, [s for s in specs if s.algorithm == "unigram"]).select("slot", F.col("token").alias("piece"), "score")


@query
def unigram_seed_pieces_all(spark, sf):
    """The seeds of every unigram slot up to its piece length, over the words that the trainer sees; without SQL."""
    specs = table(spark, sf, "slot_specs").where("algorithm = 'unigram'").select("name", F.coalesce("max_piece_length", F.lit(48)).alias("longest")).collect()  # a few rows
    words = segment.runs(docs(spark, sf)).select("slot", F.explode(F.regexp_extract_all("text", F.lit(build.WORDS), F.lit(0))).alias("text"))
    counts = materialize(training.run_counts(words.where(F.col("slot").isin([r["name"] for r in specs]))), "words")
    found = None
    for r in specs:
        one = training.seed_pieces(counts.where(F.col("slot") == r["name"]), r["longest"])
        found = one if found is None else found.unionByName(one)
    return found


@query
def baseline_train(spark, sf):
    """One vocabulary for all scripts: byte merges over a single pseudo-slot, as many as the whole budget has rows."""
    words = given(spark, sf).select(F.lit("ALL").alias("slot"), F.explode(F.regexp_extract_all("text", F.lit("\\s*\\S+"), F.lit(0))).alias("text"))
    return training.train_bpe(training.run_counts(words), 8000 - 256)


@query
def sweep_report(spark, sf):
    """Held-out tokens per character of each slot at several vocabulary sizes, and what each size saves over the one before."""
    d = given(spark, sf).select("doc_id", "text").withColumn("held", F.md5(F.col("doc_id").cast("string")) < "26")
    return compare.gain_by_size(d.where("not held"), (1000, 2000, 4000), d.where("held"))


@query
def algo_winner(spark, sf):
    """BPE against unigram of the same size on held-out runs, by slot and white space mode."""
    return compare.by_algorithm(given(spark, sf).select("doc_id", "text"), 1000)


@query
def compare_with_baseline(spark, sf):
    """The slot vocabulary against a shared one of the same size, trained on balanced pure documents, on the pure documents of each
    slot and of all, with costs and gates."""
    vocab = table(spark, sf, "slot_vocab")
    size = vocab.count()
    pure = materialize(compare.pure_documents(given(spark, sf).select("doc_id", "text")), "pure")
    shared = compare.train_shared(compare.balanced(pure), size)
    return compare.costs(materialize(compare.compared(pure, vocab, shared), "compared"), size, shared.count())


@query
def memorization_gap_tokens(spark, sf):
    """By slot: the improvement over a shared vocabulary of the same size on its training documents less that on held-out ones."""
    vocab = table(spark, sf, "slot_vocab")
    d = table(spark, sf, "corpus_docs").where("text is not null and split is not null").dropDuplicates(["doc_id"])
    pure = materialize(compare.pure_documents(d.select("doc_id", "text", (F.col("split") != "train").alias("held"))), "pure")
    return compare.gap(pure, vocab, compare.train_shared(compare.balanced(pure.where("not held")), vocab.count()))


@query
def marginal_gain_by_size(spark, sf):
    """Tokens per character of each slot at growing vocabulary sizes, and what each size saves over the one before."""
    return compare.gain_by_size(given(spark, sf).select("doc_id", "text"), (2000, 4000, 8000))


@query
def vocab_utilization_encoded(spark, sf):
    """The share of each slot's ids that the encoded documents use."""
    return compare.utilization(given(spark, sf), table(spark, sf, "slot_vocab"))


@query
def shard_write(spark, sf):
    found = codec.encoded_runs(sinks.without_blank(docs(spark, sf)), table(spark, sf, "slot_vocab"))
    size = table(spark, sf, "slot_vocab").count()
    return sinks.write_shards(found, fresh_path(spark, "shards"), 100_000, size)


@query
def corpus_registry(spark, sf):
    """The folders of each registered corpus with the name pattern of its files and its encoding in one notation."""
    e = table(spark, sf, "corpus_entries")
    encoding = F.regexp_replace(F.lower("encoding"), "[^a-z0-9]", "")
    return e.select("name", F.explode("paths").alias("path"), F.substring_index("glob_pattern", "/", -1).alias("pattern"), encoding.alias("encoding"), "weight")


@query
def documents_json_roundtrip(spark, sf):
    path = fresh_path(spark, "docs")
    d = given(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "text")
    sinks.write_documents(d, path)
    return read_documents(spark, path).select("doc_id", "kind", F.md5("text").alias("digest"))


@query
def artifact_verify(spark, sf):
    """Freeze the vocabulary, read it again, compare the files with the manifest: one row per file and its problem, if any."""
    path = fresh_path(spark, "frozen")
    manifest = TokenizerModel(table(spark, sf, "slot_vocab"), table(spark, sf, "slot_ranges")).save(path)
    return manifest.join(sinks.verify(spark, path), "file", "left").select(F.element_at(F.split("file", "/"), 1).alias("part"), F.col("problem"))
