"""Artifacts, layouts as JSON, markers, SQL functions, language models, extraction."""

import json
import math

import pytest

from lipika.functions import registered
from lipika.operators import codec, compare, corpus, language_model, slots
from lipika.sources import files, reports, sinks
from lipika.model import TokenizerModel


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, None, None, s, None) for k, s in enumerate((*slots.SPECIALS[:4], codec.SLOT_SEP))]
    rows += [(5, "LATIN", 0, "ab", -1.0), (6, "LATIN", 1, "a", -2.0), (7, "DEVANAGARI", 0, "न", -1.0)]
    rows += [(8 + b, "CATCHALL", b, f"<0x{b:02X}>", None) for b in range(256)]
    ranges = [("LATIN", 5, 7, "unigram", 2), ("DEVANAGARI", 7, 8, "unigram", 1), ("CATCHALL", 8, 264, "bytes", 256)]
    return TokenizerModel(spark.createDataFrame(rows, "id int, slot string, local_id int, token string, score double"), spark.createDataFrame(ranges, "name string, start_id int, end_id int, algorithm string, size int"))


def test_marks_and_specials(spark, model):
    docs = spark.createDataFrame([(1, "abन"), (2, None), (3, ""), (4, "ab")], "doc_id int, text string")
    encoded = model.encode(docs, mark=4)
    ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert ids == {1: [5, 4, 7], 2: [], 3: [], 4: [5]}
    assert {r["decoded"] for r in model.decode(encoded, specials=True).where("doc_id = 1").collect()} == {"abन"}
    framed = spark.createDataFrame([([1, 5, 2],)], "ids array<int>")
    assert model.decode(framed, specials=True).first()["decoded"] == "<bos>ab<eos>" and model.decode(framed).first()["decoded"] == "ab"
    with pytest.raises(Exception, match="vocabulary"):
        model.decode(spark.createDataFrame([([999],)], "ids array<int>")).collect()
    with pytest.raises(ValueError):
        model.encode(docs, mark=999)
    assert [r["ids"] for r in model.encode_runs(docs.where("doc_id = 1")).orderBy("run_pos").collect()] == [[5], [7]]
    cut = spark.createDataFrame([([8 + 0xE0, 6],)], "ids array<int>")  # half a character
    assert model.decode(cut).first()["decoded"] == "�a"


def test_groups_of_ids(spark, model):
    streams = spark.createDataFrame([(1, [1, 5, 6, 7, 2, 7]), (2, []), (3, None)], "doc_id int, ids array<int>")
    got = [tuple(r) for r in codec.id_groups(streams, model.ranges).orderBy("doc_id", "first_pos").collect()]
    assert got == [(1, 1, "LATIN", [5, 6]), (1, 3, "DEVANAGARI", [7]), (1, 5, "DEVANAGARI", [7])]


def test_layout_and_specifications_as_json(spark, model):
    said = slots.layout_json(model.ranges)
    ranges, specials, multiple = slots.layout_from_json(spark, said)
    assert ranges.collect() == model.ranges.collect() and specials == slots.SPECIALS and multiple == 128
    for change in ({"specials": ["<a>", "<a>", "<b>", "<c>", "<d>"]}, {"embed_multiple": 0}):
        with pytest.raises(ValueError):
            slots.layout_from_json(spark, json.dumps(json.loads(said) | change))
    assert slots.specs_from_config(slots.specs_json(slots.DEFAULT_SPECS)) == slots.DEFAULT_SPECS
    with pytest.raises(ValueError):
        slots.specs_from_config('{"slots": [{"name": "A"}]}')


def test_export(spark, model, tmp_path):
    path = f"file://{tmp_path}/frozen"
    specs = (slots.SlotSpec("LATIN", "unigram", ("LATIN",)), slots.SlotSpec("DEVANAGARI", "unigram", ("DEVANAGARI",)), slots.DEFAULT_SPECS[-1])
    TokenizerModel(model.vocab, model.ranges, specs=specs).save(path)
    sinks.export_for_hub(spark, path, f"file://{tmp_path}/hub")
    assert json.loads((tmp_path / "hub" / "tokenizer_config.json").read_text())["vocab_size"] == 264
    assert sinks.verify(spark, f"file://{tmp_path}/hub").count() == 0
    back = TokenizerModel.load(spark, f"file://{tmp_path}/hub")
    assert tuple(back.specs) == specs and back.vocab_size() == 264 and back.describe().count() == 3


def test_benchmark_report(spark, model):
    docs = spark.createDataFrame([("x", "ab a"), ("x", "é"), ("y", None), (None, "न न")], "kind string, text string")
    said = reports.benchmark(reports.benchmark_rows(docs, model, "kind"), 2.0)
    assert said["exact"] and said["tokens"] == sum(r["tokens"] for r in said["languages"]) and said["languages"][1]["documents"] == 2
    assert reports.benchmark_table(said).count("\n| ") == 3


def test_sql_functions(spark, model):
    registered.register(spark, model.vocab)
    spark.createDataFrame([("é ab",), (None,), ("",)], "t string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in spark.sql("SELECT text_nfc(t), size(text_runs(t)), token_text(token_ids(t)) FROM texts").collect()]
    assert got == [("é ab", 1, "é ab"), (None, 0, None), ("", 0, "")]


def test_uniform_model_costs_the_logarithm_of_the_vocabulary(spark):
    docs = spark.createDataFrame([(k, "abcd") for k in range(40)], "doc_id int, text string")
    counts = language_model.pair_counts(codec.byte_ids(docs), 1)
    held = counts.where("held").agg({"n": "sum"}).first()[0]
    empty = language_model.score(counts.where("held"), 256, 1).first()
    assert empty["tokens"] == held and abs(empty["nll"] / held - math.log(256)) < 1e-9
    found = language_model.summary(language_model.by_seed((codec.byte_ids(docs), 256, 2), (codec.byte_ids(docs), 256, 2), docs)).first()
    assert found["delta"] == 0 and not found["decisive"] and found["winner"] == "inconclusive"
    assert language_model.parameters(10, 4, 0, 3) == 10 * 4 + 3 * 4 + 8


def test_comparison_gates(spark):
    rows = [("LATIN", 1, 100, 102, 100, -2.0, False), ("KANNADA", 1, 100, 50, 100, 50.0, True)]
    frame = spark.createDataFrame(rows, "slot string, documents long, chars long, part_tokens long, base_tokens long, improvement_pct double, wins boolean")
    found = {r["slot"]: r for r in compare.costs(frame, 10, 20).collect()}
    assert found["ALL"]["part_tokens"] == 152 and found["ALL"]["wins"] and found["ALL"]["indic_better"] and not found["ALL"]["no_regression"]
    assert found["LATIN"]["part_embedding"] == 20480
    assert compare.costs(frame.where("slot = 'LATIN'"), 10, 20).first()["indic_better"] is None
    scores = spark.createDataFrame([("A", "m", "bpe", 8), ("A", "m", "unigram", 10), ("B", "m", "bpe", 5), ("B", "m", "unigram", 5)], "slot string, mode string, algorithm string, tokens long")
    assert {r["slot"]: (r["winner"], r["margin_pct"]) for r in compare.winners(scores).collect()} == {"A": ("bpe", 20.0), "B": (None, 0.0)}


def test_extraction_counts_and_stops(spark):
    said = ['{"text": "skipped"}', '{"text": "  one two  "}', "{broken", '{"text": 5}', '{"other": "x"}', '{"text": "x"}', '{"text": "three four"}', '{"text": "never reached"}']
    lines = spark.createDataFrame(list(enumerate(said, 1)), "line_no long, line string")
    taken, counts = corpus.extract_lines(lines, 1, 3, 5, 10)
    assert [tuple(r) for r in taken.orderBy("line_no").collect()] == [(2, "one t"), (7, "three")]
    assert counts.first().asDict() == {"read": 7, "broken": 1, "without": 2, "short": 1, "taken": 2, "chars": 10}


def test_corpus_is_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    made = spark.createDataFrame([("1", "k", "a")], "doc_id string, kind string, text string")
    assert files.load_or_make(spark, path, lambda: made).count() == 1
    assert files.load_or_make(spark, path, lambda: made.limit(0)).count() == 1
