"""Queries over sources, sinks, models and comparisons.

Where a tokenizer is compared and SQL should follow, the one here is the character codec: a character is the first id of
the frozen vocabulary that is this character, any other is its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registered, scripts, text
from ..model import TokenizerModel, with_tokens
from ..operators import build, codec, compare, corpus, language_model, segment, slots
from ..operators.prefix import with_number
from ..session import few, fresh_path, materialize, table
from ..sources import files, reports, sinks
from .registry import docs, given, joined, query

MARK = 4  # the id that stands between runs of different slots


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line_no, line): the documents as JSON lines of source and text, every seventh broken, every eleventh without text."""
    numbered = with_number(docs(spark, sf).select("doc_id", "source", "text"), ["doc_id"], out="line_no")
    row = F.to_json(F.struct(F.col("source").alias("group"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text")))
    return numbered.select("line_no", F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{"), row)).otherwise(row).alias("line"))


@query
def sample_lines(spark, sf):
    """Of each language the first 1,000 texts, as far as 250,000 characters go, joined by line feeds."""
    found = corpus.joined_sample(given(spark, sf).select("doc_id", "lang", "text"), ["doc_id"], ["lang"], 1000, 250_000)
    return found.select("lang", "lines", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query
def extract_lines(spark, sf):
    """Texts of JSON lines behind the first ten, 50 to 2,000 characters each, until there are 300,000 characters."""
    return corpus.extract_lines(lines(spark, sf), 10, 50, 2000, 300_000)[0].select("line_no", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query
def extract_counters(spark, sf):
    return corpus.extract_lines(lines(spark, sf), 10, 50, 2000, 300_000)[1]


@query
def group_scan(spark, sf):
    """Groups named in the first 5,000 lines: the first line of each and how many."""
    return corpus.group_scan(lines(spark, sf), "group", 5000)


@query
def registry_read(spark, sf):
    """Lines and characters of each registered corpus, written as one folder each and read by its registered paths and pattern."""
    path = fresh_path(spark, "corpora")
    name = F.replace(F.lower(F.trim("source")), F.lit("_"), F.lit("-"))
    given(spark, sf).select(name.alias("name"), F.to_json(F.struct("text")).alias("value")).where("name is not null").write.partitionBy("name").text(path)
    entries = table(spark, sf, "corpus_entries").select("name", F.array(F.concat(F.lit(f"{path}/name="), "name")).alias("paths"), F.lit("*.txt").alias("glob_pattern"))
    read = files.read_registry(spark, entries)
    return read.groupBy("name").agg(F.count("*").alias("lines"), F.sum(F.length(F.get_json_object("line", "$.text"))).alias("chars"))


@query
def id_to_token(spark, sf):
    v = table(spark, sf, "slot_vocab")
    top = v.agg(F.max("id")).first()[0]
    return with_tokens(spark.range(-2, top + 6).select(F.col("id").cast("int").alias("id")), v)


@query
def alphabet(spark, sf):
    """The bytes of the documents and the printable ASCII ones, in order."""
    seen = given(spark, sf).select(F.explode(F.array_distinct(text.utf8_bytes(F.col("text")))).alias("byte")).distinct().withColumn("observed", F.lit(True))
    safe = spark.createDataFrame([(b,) for b in (9, 10, 13, *range(32, 127))], "byte int")
    return safe.join(seen, "byte", "full").select("byte", F.coalesce("observed", F.lit(False)).alias("observed"))


@query
def marked_ids(spark, sf):
    """The bytes of each run with a mark between runs of different slots."""
    base = segment.with_runs(given(spark, sf).where("text <> ''").select("doc_id", "text"))
    ids = F.flatten(F.transform("runs", lambda r, k: F.concat(F.when(k > 0, F.array(F.lit(MARK))).otherwise(F.array().cast("array<int>")), F.transform(text.utf8_bytes(r["text"]), lambda b: b + len(slots.SPECIALS)))))
    return base.select("doc_id", F.size(ids).cast("long").alias("tokens"), joined(ids).alias("ids"))


def char_ids(spark: SparkSession, sf: str, d: DataFrame, most: int = 1 << 30) -> DataFrame:
    """``d`` with ``ids`` of the character codec, by the ids of the vocabulary below ``most``."""
    single = table(spark, sf, "slot_vocab").where((F.length("token") == 1) & (F.col("id") < most)).groupBy("token").agg(F.min("id").alias("id"))
    known = {r["token"]: r["id"] for r in few(single, 100_000, "characters of a vocabulary")}
    start = table(spark, sf, "slot_ranges").where("name = 'CATCHALL'").first()["start_id"]
    lookup = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values()))) if known else F.lit(None).cast("map<string,int>")
    chars = F.split(scripts.nfc(F.col("text")), "")
    one = F.transform("__c", lambda c: F.when(F.col("__m")[c].isNotNull(), F.array(F.col("__m")[c])).otherwise(F.transform(text.utf8_bytes(c), lambda b: b + F.lit(start))))
    return d.where("text <> ''").withColumn("__c", chars).withColumn("__m", lookup).withColumn("ids", F.flatten(one)).drop("__c", "__m")


@query
def char_encode(spark, sf):
    return char_ids(spark, sf, given(spark, sf)).select("doc_id", F.size("ids").cast("long").alias("tokens"), joined(F.col("ids")).alias("ids"))


@query
def decode_id_groups(spark, sf):
    """Token streams of the character codec between begin and end marks as groups of consecutive ids of one slot."""
    stream = char_ids(spark, sf, given(spark, sf)).select("doc_id", F.concat(F.array(F.lit(1)), "ids", F.array(F.lit(2))).alias("ids"))
    return codec.id_groups(stream, table(spark, sf, "slot_ranges")).select("doc_id", "first_pos", "slot", F.size("ids").cast("long").alias("tokens"), joined(F.col("ids")).alias("ids"))


@query
def vocab_utilization(spark, sf):
    used = char_ids(spark, sf, given(spark, sf)).select(F.explode(F.array_distinct("ids")).alias("id")).distinct()
    counts = slots.with_slot_of_id(used, table(spark, sf, "slot_ranges")).groupBy("slot").agg(F.count("*").alias("used"))
    r = table(spark, sf, "slot_ranges").select(F.col("name").alias("slot"), F.col("size").cast("long").alias("size"))
    return r.join(counts, "slot", "left").select("slot", "size", F.coalesce("used", F.lit(0)).alias("used"), (F.coalesce("used", F.lit(0)) / F.col("size")).alias("utilization"))


def _compared(spark, sf, d: DataFrame, *by: str) -> DataFrame:
    """compare.compared of the character codec with the byte codec on pure documents."""
    pure = compare.pure_documents(d.select("doc_id", "text", *(c for c in by if c != "slot")))
    both = char_ids(spark, sf, pure).select(*by, F.length(scripts.nfc(F.col("text"))).alias("chars"), F.size("ids").alias("part"), F.octet_length(scripts.nfc(F.col("text"))).alias("base"))
    return compare.rated(both.groupBy(*by).agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("part").alias("part_tokens"), F.sum("base").alias("base_tokens")))


@query
def compare_per_script(spark, sf):
    """Character codec against byte codec on the pure documents of each slot and of all, with costs and gates."""
    size = table(spark, sf, "slot_ranges").agg(F.max("end_id")).first()[0]
    return compare.costs(materialize(_compared(spark, sf, given(spark, sf), "slot"), "compared"), size, 256)


@query
def memorization_gap(spark, sf):
    """By slot: the improvement of the character codec over bytes in the train split less that in the others."""
    d = table(spark, sf, "corpus_docs").where("text is not null and split is not null and doc_id is not null")
    once = d.groupBy("doc_id").agg(F.min(F.struct("text", "split")).alias("d")).select("doc_id", "d.text", (F.col("d.split") != "train").alias("held"))
    return compare.gaps(_compared(spark, sf, once, "slot", "held"))


@query
def marginal_gain(spark, sf):
    """By language: tokens per character as more of the vocabulary is used, and what each size saves over the one before."""
    found = None
    for total in (500, 1500, 3000, 5000):
        one = char_ids(spark, sf, given(spark, sf).where("lang is not null"), most=total).groupBy("lang").agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.length(scripts.nfc(F.col("text")))).alias("chars"))
        one = one.select("lang", F.lit(total).alias("total"), "tokens", "chars")
        found = one if found is None else found.unionByName(one)
    return compare.gains(found, "lang")


@query
def algo_pivot(spark, sf):
    """The character codec and the byte codec by slot in both white space modes: tokens, winner, margin."""
    found = None
    for mode in ("leading", "neutral"):
        runs = segment.runs(docs(spark, sf), mode=mode).select("slot", "text")
        sums = char_ids(spark, sf, runs).groupBy("slot").agg(F.sum(F.size("ids")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
        one = sums.select("slot", F.lit(mode).alias("mode"), F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (algorithm, tokens)"))
        found = one if found is None else found.unionByName(one)
    return compare.winners(found, "bytes", "chars")


def _byte_streams(spark, sf) -> DataFrame:
    return codec.byte_ids(given(spark, sf))


@query
def seed_stats(spark, sf):
    """Bits per byte of a byte-bigram and a byte-unigram model over three seeds, and what the first saves."""
    streams = _byte_streams(spark, sf)
    found = language_model.by_seed((streams, 256, 2), (streams, 256, 1), given(spark, sf))
    return found.select("seed", *(F.round(c, 6).alias(c) for c in ("part_bpb", "base_bpb", "part_perplexity", "base_perplexity", "delta")))


@query
def seed_summary(spark, sf):
    streams = _byte_streams(spark, sf)
    found = language_model.summary(materialize(language_model.by_seed((streams, 256, 2), (streams, 256, 1), given(spark, sf)), "seeds"))
    return found.select("seeds", *(F.round(c, 6).alias(c) for c in ("part_bpb", "base_bpb", "delta", "spread")), "decisive", "winner")


@query
def bpb_compare(spark, sf):
    """The frozen tokenizer against bytes: bits per byte of bigram models over three seeds."""
    vocab = table(spark, sf, "slot_vocab")
    part = codec.encoded_runs(given(spark, sf), vocab).select("doc_id", "ids")
    return language_model.compare(part, _byte_streams(spark, sf), given(spark, sf), vocab.count(), 256)


@query
def lm_parameters(spark, sf):
    """Parameters of small language models over the vocabulary."""
    size = table(spark, sf, "slot_ranges").agg(F.max("end_id")).first()[0]
    rows = [(w, n, language_model.parameters(size, w, n, 256)) for w in (128, 256) for n in (2, 4)]
    return spark.createDataFrame(rows, "width int, layers int, parameters long")


@query
def lm_sample(spark, sf):
    return language_model.windows(_byte_streams(spark, sf), 256, 200, 1337)


@query
def metrics_rounded(spark, sf):
    """Sizes and ratios of each slot under the character codec, ratios to four places."""
    runs = char_ids(spark, sf, segment.runs(docs(spark, sf)).select("slot", "text"))
    sums = runs.groupBy("slot").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size("ids")).alias("tokens"))
    rates = [F.round(text.ratio(F.col(a), F.col(b)), 4).alias(n) for a, b, n in (("tokens", "chars", "tokens_per_char"), ("chars", "tokens", "chars_per_token"), ("bytes", "tokens", "bytes_per_token"))]
    return sums.select("*", *rates)


@query
def decode_digests(spark, sf):
    """Every document encoded with the frozen vocabulary and decoded again."""
    vocab = table(spark, sf, "slot_vocab")
    back = codec.decoded(codec.encoded_runs(given(spark, sf), vocab), vocab)
    return back.select("doc_id", F.md5("decoded").alias("digest"))


@query
def decode_marks(spark, sf):
    """As decode_digests, with a mark between runs that decodes to its token."""
    vocab = table(spark, sf, "slot_vocab")
    back = codec.decoded(codec.encoded_runs(given(spark, sf), vocab, mark=MARK), vocab, specials=True)
    return back.select("doc_id", F.md5("decoded").alias("digest"))


@query
def encode_run_rows(spark, sf):
    """Each run encoded by itself and decoded again."""
    model = TokenizerModel(table(spark, sf, "slot_vocab"), table(spark, sf, "slot_ranges"))
    back = model.decode(model.encode_runs(given(spark, sf)))
    return back.select("doc_id", "run_pos", "slot", F.md5("decoded").alias("digest"))


@query
def roundtrip_encoded(spark, sf):
    """Documents, how many come back exactly, ids of specials among theirs, and the first 120 characters of up to five failures."""
    vocab = table(spark, sf, "slot_vocab")
    d = given(spark, sf).withColumn("nfc", scripts.nfc(F.col("text")))
    return codec.roundtrip(codec.decoded(codec.encoded_runs(d, vocab, ("doc_id", "nfc"), "nfc"), vocab)).drop("total_ids")


@query
def lang_benchmark_encoded(spark, sf):
    model = TokenizerModel(table(spark, sf, "slot_vocab"), table(spark, sf, "slot_ranges"))
    return reports.benchmark_rows(given(spark, sf), model, "lang")


@query
def layout_roundtrip(spark, sf):
    return slots.layout_from_json(spark, slots.layout_json(table(spark, sf, "slot_ranges")))[0]


@query
def frozen_describe(spark, sf):
    """The layout of a frozen artifact, read back with its specifications."""
    path = fresh_path(spark, "frozen")
    specs = slots.specs_from_rows(r.asDict() for r in few(table(spark, sf, "slot_specs"), slots.LIMIT, "slots"))
    TokenizerModel(table(spark, sf, "slot_vocab"), table(spark, sf, "slot_ranges"), specs=specs).save(path)
    found = TokenizerModel.load(spark, path).describe()
    return found.select("name", "start_id", "end_id", "algorithm", F.array_join("scripts", ",").alias("scripts"), "structural", "trained")


@query
def shard_files(spark, sf):
    """Shards of byte ids as written: tokens and digest of each file."""
    path = fresh_path(spark, "shards")
    ids = F.transform(text.utf8_bytes(F.col("text")), lambda b: b + len(slots.SPECIALS))
    sinks.write_shards(sinks.without_blank(docs(spark, sf)).select("doc_id", ids.alias("ids")), path, 100_000, 261).collect()  # one row per shard
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return read.select(F.substring_index("path", "/", -1).alias("filename"), (F.col("length") / 2).cast("long").alias("tokens"), F.sha2("content", 256).alias("digest"))


@query
def sql_functions(spark, sf):
    """The registered functions, called from SQL."""
    registered.register(spark, table(spark, sf, "slot_vocab"))
    given(spark, sf).createOrReplaceTempView("given_documents")
    return spark.sql("SELECT doc_id, md5(text_nfc(text)) AS nfc, size(text_runs(text)) AS runs, md5(token_text(token_ids(text))) AS decoded FROM given_documents")


@query
def build_gates(spark, sf):
    """A tokenizer trained on the documents, frozen, read back and checked."""
    path = fresh_path(spark, "built")
    d = given(spark, sf).select("doc_id", "text")
    built = build.train(d, 4000)
    TokenizerModel.of(built).save(path)
    return build.gates(d, path)
