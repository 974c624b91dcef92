from lipika.operators import codec, compare


def vocabulary(spark, slots):
    rows, k = [], 0
    for slot, pieces in slots.items():
        for p in pieces:
            rows.append((k, slot, None, p, -1.0))
            k += 1
    rows += [(k + b, "CATCHALL", b, f"<0x{b:02X}>", None) for b in range(256)]
    return spark.createDataFrame(rows, "id int, slot string, local_id int, token string, score double")


def test_tokens_are_those_of_the_tokenizers(spark):
    own = vocabulary(spark, {"LATIN": ["abc", " abc"], "DEVANAGARI": ["न", "म"], "KANNADA": ["ಕ"]})
    shared = vocabulary(spark, {"ALL": ["a", "b", "c", " ", "नम"]})
    docs = spark.createDataFrame([(1, "abc abc", False), (2, "abcabc", True), (3, "नमनम", False), (4, "नम abc ಕ", False), (5, None, False)], "doc_id long, text string, held boolean")
    pure = compare.pure_documents(docs)
    got = {r["slot"]: (r["documents"], r["part_tokens"], r["base_tokens"], r["wins"]) for r in compare.compared(pure, own, shared).collect()}
    assert got == {"LATIN": (2, 4, 13, True), "DEVANAGARI": (1, 4, 2, False)}  # by bytes and characters both would win or tie
    gap = {r["slot"]: r for r in compare.gap(pure, own, shared).collect()}
    assert abs(gap["LATIN"]["gap"] - 100 * (5 / 7 - 4 / 6)) < 1e-9 and gap["DEVANAGARI"]["gap"] is None
    used = {r["slot"]: (r["size"], r["used"]) for r in compare.utilization(docs.where("doc_id < 4"), own).collect()}
    assert used == {"LATIN": (2, 2), "DEVANAGARI": (2, 2), "KANNADA": (1, 0), "CATCHALL": (256, 0)}


def test_shared_baseline_is_trained(spark):
    docs = spark.createDataFrame([(k, "moving river moving stone") for k in range(9)] + [(9, "नमस्ते दुनिया नमस्ते")], "doc_id long, text string")
    chosen = compare.balanced(compare.pure_documents(docs))
    assert {r["slot"]: r["count"] for r in chosen.groupBy("slot").count().collect()} == {"LATIN": 3, "DEVANAGARI": 1}
    vocab = compare.train_shared(docs, 330)
    assert 261 < vocab.count() <= 330
    tokens = {r["doc_id"]: r["base_tokens"] for r in compare.with_shared_tokens(docs, vocab).collect()}
    own = codec.Vocabulary.load(vocab)
    assert tokens[0] == len(own.encode("ALL", "moving river moving stone")) < 13
