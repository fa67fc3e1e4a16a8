"""Command line: index a tree, match two indexes, run both, evaluate a result."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from namefold.operators.harness import evaluate, long_range
from namefold.operators.project import OBF_PREFIX, Project
from namefold.plans.engine import Engine
from namefold.sources.index import cached_index, index_tree, read_index
from namefold.sources.results import document, read_document, summary, write_parts


def _emit(body: dict, out: str | None, indent: int | None = None) -> None:
    text = json.dumps(body, indent=indent)
    if out:
        with open(out, "w") as f:
            print(text, file=f)
    else:
        print(text)


def _match(a: DataFrame, b: DataFrame, args: argparse.Namespace) -> None:
    begun = time.time()
    engine = Engine(Project(a, args.prefix), Project(b, args.prefix), batch_sweeps=args.batch_sweeps)
    result = engine.run()
    about = summary(engine, result, run_seconds=time.time() - begun)
    if args.parts:
        write_parts(engine, result, args.parts, about)
    if args.out or not args.parts:
        _emit(document(engine, result, about), args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("namefold")
    parser.add_argument("--prefix", default=OBF_PREFIX, help="names that begin so are obfuscated")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="parse a tree of class files into an index")
    index.add_argument("tree")
    index.add_argument("out")
    for name, sides in (("match", "two indexes"), ("run", "two trees, indexed first unless they are")):
        one = commands.add_parser(name, help=f"match {sides}")
        one.add_argument("A")
        one.add_argument("B")
        one.add_argument("--out", help="file of the single JSON document")
        one.add_argument("--parts", help="folder of the result as Parquet parts")
        one.add_argument("--batch-sweeps", action="store_true")
        if name == "run":
            one.add_argument("--cache-dir", default=".")
            one.add_argument("--force-index", action="store_true")
    harness = commands.add_parser("harness", help="measure a result")
    for x in ("result", "A", "B"):
        harness.add_argument(x)
    harness.add_argument("--out")
    harness.add_argument("--per-matcher-oracle", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("namefold").getOrCreate()
    if args.command == "index":
        index_tree(spark, args.tree, args.out, args.prefix)
    elif args.command == "match":
        _match(read_index(spark, args.A), read_index(spark, args.B), args)
    elif args.command == "run":
        _match(*(cached_index(spark, tree, f"{args.cache_dir}/{side}.jsonl", args.force_index) for tree, side in ((args.A, "A"), (args.B, "B"))), args)
    else:
        a, b = (Project(read_index(spark, x), args.prefix) for x in (args.A, args.B))
        mapping, _, stats = read_document(spark, args.result)
        report = evaluate(mapping, a, b, stats)
        if args.per_matcher_oracle:
            report["per_matcher_long_range"] = {r["matcher_id"]: {k: r[k] for k in r.asDict() if k != "matcher_id"} for r in long_range(mapping, a, b).collect()}
        _emit(report, args.out, indent=2)


if __name__ == "__main__":
    main(sys.argv[1:])
