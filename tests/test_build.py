import json
import random

import pytest

from lipika import cli
from lipika.model import TokenizerModel
from lipika.operators import build, codec, slots

BANKS = {"LATIN": "the lantern river stone keeps moving under seven bridges".split(), "DEVANAGARI": "नमस्ते दुनिया पानी किताब लड़का घर".split(), "KANNADA": "ನಮಸ್ಕಾರ ಕನ್ನಡ ಮನೆ ನೀರು ಪುಸ್ತಕ".split()}


def texts(n=60):
    rng = random.Random(3)
    return [" ".join(rng.choice(bank) for _ in range(12)) + ", 12. `x = get_value(y)`" for _ in range(n) for bank in BANKS.values()] + ["中文 👩‍🔧"]


def test_build_encode_decode(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps({"doc_id": str(k), "kind": "k", "text": t}) for k, t in enumerate(texts())))
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    out = f"file://{tmp_path}/model"
    assert cli.main(["build", str(tmp_path / "docs.jsonl"), out, "--total", "1800"]) == 0
    assert capsys.readouterr().out.count("passed") == 4
    model = TokenizerModel.load(spark, out)
    sizes = {r["name"]: (r["algorithm"], r["size"]) for r in model.ranges.collect()}
    assert list(sizes) == [s.name for s in slots.DEFAULT_SPECS] and all(sizes[s.name][0] == s.algorithm for s in slots.DEFAULT_SPECS)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    encoded = model.encode(docs)
    assert {r["doc_id"]: r["decoded"] for r in model.decode(encoded).collect()} == dict(enumerate(texts()))
    stats = {r["slot"]: r for r in encoded.selectExpr("inline(run_stats)").groupBy("slot").sum("chars", "tokens").collect()}
    assert all(stats[s]["sum(tokens)"] * 2 < stats[s]["sum(chars)"] for s in BANKS)


def test_budgets_hold(spark):
    runs = spark.createDataFrame([(s, w) for s, bank in BANKS.items() for w in bank * 3] + [("NEUTRAL", ", "), ("CODE_MATH", "`get_value`")] * 2, "slot string, text string")
    budget = {"LATIN": 30, "DEVANAGARI": 25, "KANNADA": 40, "NEUTRAL": 3, "CODE_MATH": 12, "CATCHALL": 256}
    found = {r["slot"]: r["count"] for r in build.slot_pieces(runs, budget).groupBy("slot").count().collect()}
    assert set(found) == set(budget) - {"CATCHALL"} and all(n <= budget[s] for s, n in found.items())
    with pytest.raises(ValueError):
        build.assemble(build.slot_pieces(runs.where("slot <> 'KANNADA'"), budget))


def test_bpe_pieces_are_texts_of_bounded_length(spark):
    runs = spark.createDataFrame([("S", "abcabcabc")] * 5 + [("S", "é")], "slot string, text string")
    pieces, merges = build.train_slots(runs, {"S": 8}, [slots.SlotSpec("S", "bpe", max_piece_length=3)])
    found = [r["token"] for r in pieces.collect()]
    assert set("abcé") <= set(found) and "abc" in found and max(map(len, found)) <= 3 and len(found) <= 8
    assert {r["left"] + r["right"] for r in merges.collect()} <= set(found)


def test_bpe_slots_are_encoded_by_their_merges(spark):
    """A closed loop: what was trained encodes, and as training split its runs."""
    runs = spark.createDataFrame([("NEUTRAL", t) for t in ["--__--", "--__", "__--__", "!?"] * 6], "slot string, text string")
    specs = [slots.SlotSpec("NEUTRAL", "bpe"), slots.DEFAULT_SPECS[-1]]
    pieces, merges = build.train_slots(runs, {"NEUTRAL": 12}, specs)
    vocab, _ = build.assemble(pieces, specs)
    own = codec.Vocabulary.load(vocab, merges)
    assert own.merges["NEUTRAL"]
    for text in ("--__--", "!?", "-_x!"):
        assert own.decode(own.encode("NEUTRAL", text)) == text
    assert len(own.encode("NEUTRAL", "--__--")) < 4
