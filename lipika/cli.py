"""Command line: python -m lipika.cli segment|metrics|encode|decode|shard|build|benchmark|bpb ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import TokenizerModel
from .operators import build, codec, language_model, segment, slots
from .session import build_session, fresh_path, ship
from .sources import files, reports, sinks

COMMANDS = ("segment", "metrics", "encode", "decode", "shard", "build", "benchmark", "bpb")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lipika")
    sub = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        if name in ("encode", "decode", "shard", "benchmark", "bpb"):
            p.add_argument("--model", required=True, help="folder of a frozen tokenizer")
        p.add_argument("--mode", choices=("leading", "neutral"), default="leading")
        p.add_argument("--shard-tokens", type=int, default=100_000_000)
        p.add_argument("--specials", action="store_true", help="decode: write special tokens too")
        p.add_argument("--total", type=int, default=8000, help="build: rows of the vocabulary")
        p.add_argument("--alpha", type=float, default=0.7)
        p.add_argument("--least", type=int, default=300)
        p.add_argument("--most", type=int, default=4000)
        p.add_argument("--slots", help="build: file with the specifications of the slots")
        p.add_argument("--report", help="build: file for the report")
        p.add_argument("--seeds", type=int, default=3)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    ship(spark)
    return {"build": run_build, "decode": run_decode}.get(args.command, run_other)(spark, args)


def run_build(spark: SparkSession, args: argparse.Namespace) -> int:
    docs = files.read_documents(spark, args.input)
    specs = slots.DEFAULT_SPECS
    if args.slots:
        specs = slots.specs_from_config("\n".join(r[0] for r in spark.read.text(args.slots, wholetext=True).collect()))
    built = build.train(docs, args.total, args.mode, specs, alpha=args.alpha, least=args.least, most=args.most)
    TokenizerModel.of(built, args.mode).save(args.output)
    checked = build.gates(docs, args.output, args.mode)
    report = build.report(docs, built, checked, args.mode)
    sinks.write_text(spark, args.report or f"{args.output}/build_report.json", json.dumps(report, ensure_ascii=False, indent=1))
    print(*(f"{gate}: {'passed' if passed else 'failed'}" for gate, passed in report["gates"].items()), sep="\n")
    return int(not all(report["gates"].values()))


def run_decode(spark: SparkSession, args: argparse.Namespace) -> int:
    model = TokenizerModel.load(spark, args.model, args.mode)
    model.decode(spark.read.parquet(args.input), out="text", specials=args.specials).select("doc_id", "text").write.mode("overwrite").json(args.output)
    return 0


def run_other(spark: SparkSession, args: argparse.Namespace) -> int:
    docs: DataFrame = files.read_documents(spark, args.input)
    if args.command == "segment":
        sinks.write_slot_corpus(segment.runs(docs, mode=args.mode), args.output).show()
        return 0
    if args.command == "metrics":
        found = segment.runs(docs, mode=args.mode).groupBy("slot").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
        found.coalesce(1).write.mode("overwrite").json(args.output)
        return 0
    model = TokenizerModel.load(spark, args.model, args.mode)
    if args.command == "encode":
        model.encode(docs).select("doc_id", "ids").write.mode("overwrite").parquet(args.output)
    elif args.command == "shard":
        manifest = sinks.write_shards(model.encode(sinks.without_blank(docs)), args.output, args.shard_tokens, model.vocab_size())
        said = sinks.manifest_json(manifest)
        sinks.write_text(spark, f"{args.output}/manifest.json", said)
        print(said)
    elif args.command == "benchmark":
        began = time.time()
        model.encode(docs).write.parquet(fresh_path(spark, "bench"))
        rows = reports.benchmark_rows(docs, model, "kind")
        said = reports.benchmark(rows, time.time() - began)
        sinks.write_text(spark, f"{args.output}/benchmark.json", json.dumps(said, ensure_ascii=False, indent=1))
        sinks.write_text(spark, f"{args.output}/benchmark.md", reports.benchmark_table(said))
    else:
        part = model.encode(docs).select("doc_id", "ids")
        base = codec.byte_ids(docs)
        rows = language_model.compare(part, base, docs, model.vocab_size(), 256, args.seeds)
        rows.coalesce(1).write.mode("overwrite").json(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
