"""Sinks: documents, slot corpora, frozen vocabularies with hashes, token shards of exact size."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_SPACE
from ..operators import slots
from ..operators.prefix import with_before
from ..operators.slots import SlotSpec
from ..session import file_system, materialize
from .files import write_documents  # noqa: F401  a sink too


def write_slot_corpus(runs: DataFrame, path: str) -> DataFrame:
    """Runs into one folder per slot, in place of what was there; returns (slot, bytes)."""
    runs.write.mode("overwrite").partitionBy("slot").parquet(path)
    return runs.sparkSession.read.parquet(path).groupBy("slot").agg(F.sum(F.octet_length("text")).alias("bytes"))


MERGES = "slot string, rank int, left string, right string"
PARTS = ("vocab", "layout", "merges", "texts")  # folders of an artifact whose files the manifest lists


def freeze(vocab: DataFrame, ranges: DataFrame, path: str, specs: Sequence[SlotSpec] = slots.DEFAULT_SPECS, merges: DataFrame | None = None) -> DataFrame:
    """Vocabulary, layout and merges as Parquet, layout and specifications as JSON, with a manifest of the files' SHA-256;
    rejects gaps between vocabulary and layout."""
    spark = vocab.sparkSession
    rows = vocab.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("top")).first()
    top = ranges.agg(F.max("end_id").alias("end")).first()["end"]
    if not rows["n"] == rows["ids"] == rows["top"] + 1 == top:
        raise ValueError(f"{rows['n']} rows, {rows['ids']} ids up to {rows['top']}, layout up to {top}")
    merges = spark.createDataFrame([], MERGES) if merges is None else merges
    vocab.orderBy("id").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    ranges.orderBy("start_id").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    merges.orderBy("slot", "rank").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    texts = [("layout.json", slots.layout_json(ranges)), ("slots.json", slots.specs_json(specs))]
    spark.createDataFrame(texts, "name string, said string").coalesce(1).write.mode("overwrite").parquet(f"{path}/texts")
    hashes(spark, path).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def frozen_text(spark: SparkSession, path: str, name: str) -> str:
    """A JSON text of an artifact: layout.json or slots.json."""
    return spark.read.parquet(f"{path}/texts").where(F.col("name") == name).first()["said"]


def hashes(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{part}" for part in PARTS])
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of files that are missing, new or changed since freeze; none if the artifact is sound."""
    both = spark.read.json(f"{path}/manifest").withColumnRenamed("sha256", "said").join(hashes(spark, path), "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("said").isNull(), "unknown").when(F.col("said") != F.col("sha256"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def export_for_hub(spark: SparkSession, path: str, out: str) -> None:
    """A copy of an artifact with a tokenizer_config.json beside it that names its special tokens."""
    source, system = file_system(spark, path)
    target, there = file_system(spark, out)
    there.delete(target, True)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(system, source, there, target, False, spark.sparkContext._jsc.hadoopConfiguration())
    names = [f"{n}_token" for n in ("pad", "bos", "eos", "unk", "mask")]
    size = json.loads(frozen_text(spark, path, "layout.json"))["slots"][-1]["end_id"]
    write_text(spark, f"{out}/tokenizer_config.json", json.dumps(dict(zip(names, slots.SPECIALS)) | {"vocab_size": size, "add_prefix_space": False}, indent=1))


def write_text(spark: SparkSession, path: str, said: str) -> None:
    """A small text file in place of what was there, on whatever file system."""
    target, system = file_system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(said.encode()))
    finally:
        stream.close()


def shard_pieces(placed: DataFrame, size: Column, shard: int) -> DataFrame:
    """(shard, from_offset, to_offset, ...): documents cut where a shard ends; offsets within the whole stream."""
    last = F.floor((F.col("offset") + size - 1) / shard)
    cut = placed.where(size > 0).withColumn("shard", F.explode(F.sequence(F.floor(F.col("offset") / shard), last)))
    return cut.withColumn("from_offset", F.greatest(F.col("offset"), F.col("shard") * shard)).withColumn("to_offset", F.least(F.col("offset") + size, (F.col("shard") + 1) * shard))


def write_shards(encoded: DataFrame, path: str, shard: int, vocab_size: int, key: str = "doc_id", eos: int = 2) -> DataFrame:
    """Token streams as little-endian files of exactly ``shard`` tokens (the last may be shorter), each document followed by
    ``eos``; returns the manifest (shard_index, filename, num_tokens, dtype). Documents without tokens are left out, also
    those that are only white space if their caller drops them (see without_blank).

    ``path`` is a folder all executors share, on any file system; what was there goes. A shard is written under a name
    of its own and renamed, so a task that runs again or twice leaves one whole file.
    """
    spark = encoded.sparkSession
    kind = "uint16" if vocab_size < 65536 else "uint32"
    ids = F.array_append("ids", F.lit(eos))
    given = materialize(encoded.where("size(ids) > 0").select(key, ids.alias("ids")), "encoded")
    sizes = given.select(key, F.size("ids").cast("long").alias("n"))  # only keys and sizes go through the running sum
    starts = with_before(sizes, F.col("n"), [key], out="offset").select(key, "offset")
    cut = shard_pieces(given.join(starts, key), F.size("ids"), shard)
    pieces = cut.select("shard", "from_offset", F.expr("slice(ids, cast(from_offset - offset as int) + 1, cast(to_offset - from_offset as int))").alias("ids"))
    ordered = pieces.repartition("shard").sortWithinPartitions("shard", "from_offset")
    target, system = file_system(spark, path)
    system.delete(target, True)
    system.mkdirs(target)
    uri = path if "://" in path or path.startswith("file:") else f"{system.getUri().toString().rstrip('/')}{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(uri)
        number, out, name, done = None, None, "", {}

        def close() -> None:
            if out is not None:
                out.close()
                files.move(name, f"{base}/shard_{number:05d}.bin")

        for batch in batches:
            for shard_no, values in zip(batch.column(0).to_pylist(), batch.column(2)):
                if shard_no != number:
                    close()
                    number, name = shard_no, f"{base}/.shard_{shard_no:05d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(name)
                flat = values.values.to_numpy().astype("<u2" if kind == "uint16" else "<u4")
                out.write(flat.tobytes())
                done[shard_no] = done.get(shard_no, 0) + len(flat)
        close()
        names = ["shard_index", "filename", "num_tokens", "dtype"]
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int64()), pa.array([f"shard_{k:05d}.bin" for k in done], pa.string()), pa.array(list(done.values()), pa.int64()), pa.array([kind] * len(done), pa.string())], names=names)

    return ordered.mapInArrow(write, "shard_index long, filename string, num_tokens long, dtype string")


def without_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without null texts and those that are only white space."""
    return docs.where(F.col(text).rlike(f"[^{WORD_SPACE[1:-1]}]"))


def manifest_json(manifest: DataFrame) -> str:
    rows = [r.asDict() for r in manifest.orderBy("shard_index").collect()]  # one row per shard
    return json.dumps({"shards": rows, "total_tokens": sum(r["num_tokens"] for r in rows), "num_shards": len(rows)})
