"""Segmentation: documents into runs of one slot, as rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_runs import RUN_TYPE, SCRIPT_OF_CLASS, Cutter, class_counts
from ..functions.scripts import CATCHALL, CODE_MATH, DEFAULT_SLOT_MAP, NEUTRAL


def cutter(mode: str = "leading", form: str = "NFC", slot_map: Mapping[str, str] | None = None, structural: str = CODE_MATH) -> Cutter:
    return Cutter(DEFAULT_SLOT_MAP if slot_map is None else slot_map, mode, structural, NEUTRAL, CATCHALL, form)


def with_runs(docs: DataFrame, text: str = "text", mode: str = "leading", form: str = "NFC", slot_map: Mapping[str, str] | None = None, structural: str = CODE_MATH) -> DataFrame:
    """``docs`` with ``runs`` in place of a column of that name: array of (slot, text, start, end, script) in text order; null
    or empty texts have none.

    Offsets are code points of the normalized text; ``script`` is that of the run's first character.
    """
    own = cutter(mode, form, slot_map, structural)
    docs = docs.withColumn("__t", F.coalesce(text, F.lit(""))).drop("runs")
    kept = len(docs.columns) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in own.parts(batch.column(kept)):
                columns = [batch.column(k).slice(at, len(part)) for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, own.cut(part).structs()], names=[*batch.schema.names[:kept], "runs"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:kept]), f"runs {RUN_TYPE}"])
    return docs.mapInArrow(cut, schema)


def runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", mode: str = "leading", form: str = "NFC", slot_map: Mapping[str, str] | None = None, structural: str = CODE_MATH) -> DataFrame:
    """One row per run: the keys, run_pos from 0 on, slot, text, start, end, script."""
    own = cutter(mode, form, slot_map, structural)
    given = docs.select(*keys, F.col(text).alias("__t")).where("length(__t) > 0")
    kept = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in own.parts(batch.column(kept)):
                found = own.cut(part)
                row = found.row
                pos = np.arange(len(row)) - found.offsets[row]
                columns = [batch.column(k).slice(at, len(part)).take(pa.array(row)) for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pos.astype(np.int32)), *found.fields()], names=[*batch.schema.names[:kept], "run_pos", "slot", "text", "start", "end", "script"])

    types = dict(given.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "run_pos int, slot string, text string, start int, `end` int, script string"])
    return given.mapInArrow(cut, schema)


def script_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(script, chars): the characters of each script before marks and white space are settled; white space is COMMON, marks
    and joiners are INHERITED."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SCRIPT_OF_CLASS), np.int64)
        for batch in batches:
            total += class_counts(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(SCRIPT_OF_CLASS).take(pa.array(at)), pa.array(total[at])], names=["script", "n"])

    parts = docs.select(F.col(text)).where(f"length({text}) > 0").mapInArrow(count, "script string, n long")
    return parts.groupBy("script").agg(F.sum("n").alias("chars"))
