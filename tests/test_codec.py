import numpy as np
import pytest

from lipika.operators import codec, training
from lipika.sources import files, sinks

TEXTS = ["", "abc abc", "नमस्ते दुनिया", "ಕನ್ನಡ", "emoji 👩‍🔧 中", "$x^2$ and `code`", "\x01\x02", "a" * 5000, "tab\tnew\nline"]


@pytest.fixture(scope="module")
def vocab(spark):
    rows, k = [(i, None, None, s, None) for i, s in enumerate(["<pad>", "<bos>", "<eos>", "<unk>", "<mask>"])], 5
    for slot, pieces in (("LATIN", ["a", "b", "c", "ab", "abc", " abc", " "]), ("DEVANAGARI", ["न", "म", "नम"])):
        for p in pieces:
            rows.append((k, slot, None, p, -1.0 - 0.1 * len(p)))
            k += 1
    rows += [(k + b, "CATCHALL", b, f"<0x{b:02X}>", None) for b in range(256)]
    return spark.createDataFrame(rows, "id int, slot string, local_id int, token string, score double")


def test_lossless_and_best_path(spark, vocab):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for mode in ("leading", "neutral"):
        back = codec.decoded(codec.encoded_runs(docs, vocab, mode=mode), vocab).orderBy("doc_id").collect()
        assert [r["decoded"] for r in back] == TEXTS
    own = codec.Vocabulary.load(vocab)
    assert [own.texts[i] for i in own.encode("LATIN", "abc abc")] == ["abc", " abc"]
    assert len(own.encode("LATIN", "é")) == 2
    with pytest.raises(ValueError):
        own.decode([10_000])


def test_shards_are_exact(spark, vocab, tmp_path):
    docs = spark.createDataFrame([(k, "abc " * (k % 7)) for k in range(60)] + [(99, None)], "doc_id long, text string")
    encoded = codec.encoded_runs(docs, vocab)
    rows = sinks.write_shards(encoded, str(tmp_path / "out"), 50, 300).orderBy("shard_index").collect()
    assert all(r["num_tokens"] == 50 for r in rows[:-1]) and rows[0]["dtype"] == "uint16"
    stream = np.concatenate([np.fromfile(tmp_path / "out" / r["filename"], "<u2") for r in rows])
    want = [i for r in encoded.orderBy("doc_id").collect() if r["ids"] for i in [*r["ids"], 2]]
    assert stream.tolist() == want


def test_bpe_is_deterministic_and_matches_first_pairs(spark):
    counts = spark.createDataFrame([("LATIN", "abab", 3), ("LATIN", "abc", 2), ("LATIN", "xyxy", 4)], "slot string, text string, n long")
    pairs = {(r["first"], r["second"]): r["n"] for r in training.first_pairs(counts).collect()}
    assert pairs[97, 98] == 8 and pairs[120, 121] == 8
    merges = training.train_bpe(counts, 3).orderBy("rank").collect()
    assert (merges[0]["left"], merges[0]["right"], merges[0]["n"]) == ("61", "62", 8)
    assert [tuple(r) for r in merges] == [tuple(r) for r in training.train_bpe(counts.orderBy("n"), 3).orderBy("rank").collect()]


def test_unigram_keeps_characters(spark):
    counts = spark.createDataFrame([("K", t, n) for t, n in (("banana", 9), ("bandana", 5), ("cab", 2))], "slot string, text string, n long")
    rows = training.train_unigram(counts, 10, 4, 2).collect()
    pieces = {r["piece"] for r in rows}
    assert set("bandc") <= pieces and len(pieces) <= 10 and any(len(p) > 1 for p in pieces)
    seeds = {r["piece"]: r["n"] for r in training.seed_pieces(counts, 2).collect()}
    assert seeds["an"] == 9 * 2 + 5 * 2 and seeds["c"] == 2


def test_freeze_and_verify(spark, vocab, tmp_path):
    ranges = spark.createDataFrame([("LATIN", 5, 12, "unigram", 7), ("DEVANAGARI", 12, 15, "unigram", 3), ("CATCHALL", 15, 271, "bytes", 256)], "name string, start_id int, end_id int, algorithm string, size int")
    path = f"file://{tmp_path}/art"
    assert sinks.freeze(vocab, ranges, path).count() == len(sinks.PARTS)
    assert sinks.verify(spark, path).count() == 0
    vocab.limit(3).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    assert {r["problem"] for r in sinks.verify(spark, path).collect()} == {"missing", "unknown"}
    with pytest.raises(ValueError):
        sinks.freeze(vocab.where("id <> 7"), ranges, path)


def test_sources(spark, tmp_path):
    lines = ['{"text": "one"}', '{"content": "two"}', '{"target": "three"}', "{broken", "plain", "   ", '{"text": ""}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    assert sorted(r[0] for r in files.read_loose(spark, str(tmp_path / "in.jsonl")).collect()) == ["one", "plain", "three", "two", "{broken"]
    docs = spark.createDataFrame([("a", "k", "ä\nb")], files.DOCUMENT)
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert files.read_documents(spark, str(tmp_path / "docs")).collect() == docs.collect()
    assert files.read_registered(spark, [str(tmp_path)], "**/*.jsonl").count() == len(lines)
