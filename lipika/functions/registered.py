"""The engine's functions under names of their own in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, segment
from .arrow_runs import RUN_TYPE, composed


def register(spark: SparkSession, vocab: DataFrame | None = None, merges: DataFrame | None = None, mode: str = "leading") -> list[str]:
    """Registers text_nfc(text), text_runs(text) and, with a vocabulary, token_ids(text) and token_text(ids); returns the names."""
    cutter = segment.cutter(mode)

    @F.arrow_udf("string")
    def text_nfc(v: pa.Array) -> pa.Array:
        return composed(v)

    @F.arrow_udf(RUN_TYPE)
    def text_runs(v: pa.Array) -> pa.Array:
        return pa.concat_arrays([cutter.cut(part).structs() for _, part in cutter.parts(v.fill_null(""))])

    found = {"text_nfc": text_nfc, "text_runs": text_runs}
    if vocab is not None:
        shared = spark.sparkContext.broadcast(codec.Vocabulary.load(vocab, merges))

        @F.arrow_udf("array<int>")
        def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = shared.value
            for v in batches:
                rows: list[list[int] | None] = []
                for at, part in cutter.parts(v.fill_null("")):
                    runs = cutter.cut(part)
                    ids = [own.encode(s, t) for s, t in zip(runs.slot.to_pylist(), runs.text.to_pylist())]
                    for k in range(len(part)):
                        rows.append([i for run in ids[runs.offsets[k] : runs.offsets[k + 1]] for i in run] if v[at + k].is_valid else None)
                yield pa.array(rows, pa.list_(pa.int32()))

        @F.arrow_udf("string")
        def token_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec.Decoder(shared.value, False)
            for v in batches:
                yield own(v)

        found |= {"token_ids": token_ids, "token_text": token_text}
    for name, function in found.items():
        spark.udf.register(name, function)
    return list(found)
