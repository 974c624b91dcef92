import os

import pytest

from lipika import TokenizerModel
from lipika.model import framed, padded_batches, without_specials

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_save_load_encode_decode(spark, tmp_path):
    first = TokenizerModel(spark.read.parquet(f"{DATA}/slot_vocab.parquet"), spark.read.parquet(f"{DATA}/slot_ranges.parquet"))
    first.save(f"file://{tmp_path}/m")
    model = TokenizerModel.load(spark, f"file://{tmp_path}/m")
    assert model.vocab_size() == 4961
    docs = spark.createDataFrame([(1, "the क ಕ $x$ 中"), (2, ""), (3, None)], "doc_id long, text string")
    encoded = model.encode(docs)
    back = {r["doc_id"]: r["decoded"] for r in model.decode(encoded).collect()}
    assert back == {1: "the क ಕ $x$ 中", 2: "", 3: ""}
    marked = encoded.select("doc_id", framed(encoded["ids"]).alias("ids"))
    assert [r["ids"][0] for r in marked.collect()] == [1, 1, 1]
    rows = {r["doc_id"]: r for r in padded_batches(marked.selectExpr("*", "0 as batch"), ["batch"]).collect()}
    assert len({len(r["ids"]) for r in rows.values()}) == 1 and sum(rows[2]["attention_mask"]) == 2
    assert [r[0] for r in marked.where("doc_id = 2").select(without_specials(marked["ids"])).collect()] == [[]]
    assert model.runs(docs).count() > 3 and model.describe().count() == 6
    assert {r["id"]: r["token"] for r in model.tokens_of_ids(spark.createDataFrame([(0,), (99999,)], "id int")).collect()} == {0: "<pad>", 99999: "<unk>"}
    assert model.ids_of_tokens().where("token = '<bos>'").first()["id"] == 1
