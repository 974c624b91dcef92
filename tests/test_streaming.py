import json

from lipika.operators.segment import runs
from lipika.streaming import segmenting


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doc_id": str(k), "kind": "x", "text": t} for k, t in enumerate(["abc नमस्ते", "$x$ y", "ಕನ್ನಡ"])]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    docs = segmenting.stream_documents(spark, str(tmp_path / "in"))
    segmenting.write_runs(docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = runs(spark.createDataFrame(rows, "doc_id string, kind string, text string"))
    key = ["doc_id", "run_pos", "slot", "text"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
