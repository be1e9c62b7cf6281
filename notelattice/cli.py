"""Command line: index, search, status and clear."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from notelattice.config import get_settings, load_env
from notelattice.plans.indexing import index_directory
from notelattice.plans.searching import MODES, SEEDS, format_results, search
from notelattice.session import scratch_scope
from notelattice.sources.index_store import IndexStore


def main(argv: list[str] | None = None) -> int:
    load_env()
    settings = get_settings()
    parser = argparse.ArgumentParser(prog="notelattice")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("directory")
    one.add_argument("--extract-depth", choices=("structural", "ner"))
    one.add_argument("--entity-types")
    one.add_argument("--exclude", action="append", default=[])
    one.add_argument("--rebuild", action="store_true")
    two = commands.add_parser("search")
    two.add_argument("query")
    two.add_argument("--mode", choices=MODES, default="hybrid")
    two.add_argument("--graph-seed", choices=SEEDS, default="bm25")
    two.add_argument("--top", type=int, default=settings.default_top_k)
    two.add_argument("--no-rerank", action="store_true")
    two.add_argument("--no-expand", action="store_true")
    commands.add_parser("status")
    commands.add_parser("clear")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("notelattice").getOrCreate()
    if args.command == "index" and args.entity_types:
        settings = dataclasses.replace(settings, ner_entity_types=tuple(x.strip() for x in args.entity_types.split(",") if x.strip()))
    store = IndexStore(spark, settings.index_dir, settings)
    if args.command == "index":
        print(index_directory(spark, store, args.directory, args.exclude, args.rebuild, args.extract_depth))
    elif args.command == "search":
        queries = spark.createDataFrame([(0, args.query)], "query_id int, query string")
        with scratch_scope():
            found = search(store, queries, args.mode, args.top, not args.no_rerank, not args.no_expand, args.graph_seed)
            for row in format_results(found).orderBy("place").collect():  # at most --top rows
                print(row["line"])
    elif args.command == "status":
        print(store.statistics().first().asDict())
    else:
        store.clear()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
