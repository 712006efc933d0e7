"""Command line: ingest, statistics, search, ask, evaluate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators.embed import Embedder
from quarry.plans import reports as RP
from quarry.plans.recipes import RECIPES, Corpus, ask, search
from quarry.settings import Settings
from quarry.sources import pages as SP
from quarry.sources.api import TableSource
from quarry.sources.store import Library, Store
from quarry.streaming.ingest import Ingest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry")
    sub = out.add_subparsers(dest="command", required=True)
    pages = sub.add_parser("ingest", help="take in pages and make the indexes")
    pages.add_argument("--dump", help="pages as JSON lines; else the folder of fixtures")
    pages.add_argument("--restart", action="store_true")
    sub.add_parser("stats", help="what the last ingest kept and skipped")
    for name in ("search", "ask"):
        one = sub.add_parser(name)
        one.add_argument("question")
        one.add_argument("--recipe")
    ev = sub.add_parser("eval")
    ev.add_argument("--gold", default="v1")
    ev.add_argument("--k", type=int, default=8)
    modes = ev.add_mutually_exclusive_group()
    modes.add_argument("--recipe")
    modes.add_argument("--compare", action="store_true")
    return out


def questions(spark: SparkSession, texts: list[str], embedder: Embedder) -> DataFrame:
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")
    v = embedder.embedded(q.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("embed_text")))
    return q.join(v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("v")), "query_id")


def gold_items(spark: SparkSession, path: str, corpus: Corpus, embedder: Embedder) -> DataFrame:
    """Resolved gold questions as ``evaluated`` takes them."""
    docs = corpus.chunks.select("doc_id", "title").distinct()
    gold = E.resolve_gold(SP.read_lines(spark, path, SP.GOLD), docs).withColumnRenamed("id", "query_id").withColumnRenamed("question", "text")
    v = embedder.embedded(gold.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("embed_text")))
    return gold.join(v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("v")), "query_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> str:
    """Run a command, print what it says and return it."""
    args, settings = parser().parse_args(argv), settings or Settings.from_env()
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    embedder = Embedder(settings.embedding_dims)
    store = Store(spark, settings.store)
    library = Library(store, embedder)
    if args.command in ("ingest", "stats"):
        if args.command == "ingest":
            source = TableSource(SP.read_dump(spark, args.dump) if args.dump else SP.read_fixtures(spark, settings.fixtures))
            ingest = Ingest(store, source, settings.batch_size)
            library.rebuild(ingest.run(args.restart))
        else:
            ingest = Ingest(store, TableSource(None), settings.batch_size)
        said = RP.stats_text(ingest.stats())
    elif args.command == "eval":
        corpus = library.bring_up()
        items = gold_items(spark, settings.gold(args.gold), corpus, embedder)
        chosen = [r for r in RECIPES.values() if r.backend != "cross_encoder"] if args.compare else [RECIPES[args.recipe or settings.default_recipe]]
        whole, by_type = RP.comparison(corpus, items, chosen, args.k)
        report = RP.comparison_report(args.gold, args.k, items, whole, by_type)
        RP.write_report(spark, report, f"{settings.reports}/{args.gold}")
        said = RP.comparison_text(report)
    else:
        corpus, recipe = library.bring_up(), RECIPES[args.recipe or settings.default_recipe]
        q = questions(spark, [args.question], embedder)
        out = search(corpus, q, recipe) if args.command == "search" else ask(corpus, q, recipe)
        said = "\n".join(json.dumps(r.asDict(), default=str) for r in (out.orderBy("rank") if "rank" in out.columns else out).collect())  # k_final rows
    print(said)
    return said


if __name__ == "__main__":
    main()
