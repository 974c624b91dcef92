import os

import pytest

from lipika.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_unigram_slot_is_trained(spark):
    want = {r["name"] for r in spark.read.parquet(f"{DATA}/slot_specs.parquet").where("algorithm = 'unigram'").collect()}
    rows = queries.queries()["unigram_train"](spark, DATA).collect()
    assert {r["slot"] for r in rows} == want == {"LATIN", "DEVANAGARI", "KANNADA"}
    assert max(len(r["piece"]) for r in rows) > 6 and len(rows) > 1800
    seeds = queries.queries()["unigram_seed_pieces_all"](spark, DATA).selectExpr("slot", "length(piece) as k").groupBy("slot").max("k").collect()
    assert {r[0] for r in seeds} == want and max(r[1] for r in seeds) > 8
