"""Reports: recipes side by side, their record as JSON, and tables for people to read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import retrieve as R
from quarry.plans.recipes import Corpus, Recipe, search


def evaluated(corpus: Corpus, items: DataFrame, recipe: Recipe, k: int = 8, model=None) -> tuple[DataFrame, DataFrame]:
    """The report row of a recipe over resolved gold (query_id, text, question_type,
    resolved_ids, unresolved_ids, unresolved_titles, status and, for vectors, v), and
    those by question type. Nothing is searched for items without a resolved label."""
    on = items.filter(F.size("resolved_ids") > 0)
    hits = R.beside(search(corpus, on, recipe, model=model), corpus.chunks.select("id", "doc_id"), items, recipe.k_final)
    docs = R.deduplicated_docs(hits.select("query_id", "doc_id", "rank"))
    metrics = E.item_metrics(on.select("query_id", F.explode("resolved_ids").alias("doc_id")), docs, k)
    labels = F.sum(((F.size("unresolved_ids") > 0) | (F.size("unresolved_titles") > 0)).cast("long")).alias("n_with_unresolved_labels")
    named = lambda df: df.select(*[c for c in ("question_type",) if c in df.columns], F.lit(recipe.id).alias("config_id"), F.lit(recipe.backend).alias("rerank_backend"), F.col("questions").alias("n"), F.col("evaluated").alias("n_evaluated"), F.col("unresolved").alias("n_unresolved"), F.col("partial").alias("n_partial"), "recall", "mrr", "ndcg")
    whole = named(E.report(items, metrics)).join(items.agg(F.coalesce(labels, F.lit(0)).alias("n_with_unresolved_labels")))  # a row each
    return whole, named(E.report(items, metrics, ["question_type"]))


def comparison(corpus: Corpus, items: DataFrame, recipes: list[Recipe], k: int = 8, model=None) -> tuple[DataFrame, DataFrame]:
    """Report rows of several recipes, as ``evaluated`` gives them."""
    parts = [evaluated(corpus, items, r, k, model) for r in recipes]
    whole, by_type = parts[0]
    for a, b in parts[1:]:
        whole, by_type = whole.unionByName(a), by_type.unionByName(b)
    return whole, by_type


def comparison_report(gold_set: str, k: int, items: DataFrame, whole: DataFrame, by_type: DataFrame) -> dict:
    """The comparison as one record, with eleven keys for each recipe; a few rows."""
    types: dict[str, dict] = {}
    for r in by_type.orderBy("config_id", "question_type").collect():
        types.setdefault(r["config_id"], {})[r["question_type"]] = {"n": r["n"], "n_evaluated": r["n_evaluated"], "n_unresolved": r["n_unresolved"], "recall@k": r["recall"], "mrr": r["mrr"], "ndcg@k": r["ndcg"]}
    configs = [
        {
            "config_id": r["config_id"], "rerank_backend": r["rerank_backend"], "n": r["n"], "n_evaluated": r["n_evaluated"], "n_unresolved": r["n_unresolved"], "n_partial": r["n_partial"],
            "n_with_unresolved_labels": r["n_with_unresolved_labels"], "recall@k": r["recall"], "mrr": r["mrr"], "ndcg@k": r["ndcg"], "by_question_type": types.get(r["config_id"], {}),
        }
        for r in whole.collect()
    ]
    labels = [r.asDict() for r in E.unresolved_labels(items.withColumn("id", F.col("query_id"))).orderBy("id").collect()]
    return {"gold_set": gold_set, "k": k, "unresolved_labels": labels, "configs": configs}


def write_report(spark, report: dict, path: str) -> None:
    """Replace a report: one line of JSON, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def table_text(names: list[str], rows: list[tuple]) -> str:
    """Rows as text in columns: numbers to the right, fractions with three digits."""
    shown = [[f"{x:.3f}" if isinstance(x, float) else str(x) for x in row] for row in rows]
    wide = [max(len(n), *(len(r[i]) for r in shown)) if shown else len(n) for i, n in enumerate(names)]
    right = [bool(rows) and not isinstance(rows[0][i], str) for i in range(len(names))]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, wide, right, strict=True)).rstrip()
    return "\n".join([line(names), "-" * (sum(wide) + 2 * len(wide) - 2), *map(line, shown)])


def comparison_text(report: dict) -> str:
    measures = ("recall@k", "mrr", "ndcg@k")
    rows = [(c["config_id"], f"{c['n_evaluated']}/{c['n']}", c["n_unresolved"], *(float(c[m]) for m in measures)) for c in report["configs"]]
    typed = [(c["config_id"], t, f"{x['n_evaluated']}/{x['n']}", *(float(x[m]) for m in measures)) for c in report["configs"] for t, x in c["by_question_type"].items()]
    return table_text(["config", "evaluated", "unresolved", *measures], rows) + "\n\n" + table_text(["config", "type", "evaluated", *measures], typed)


def stats_text(stats: dict) -> str:
    """Ingest statistics in lines."""
    some = lambda xs: [f"  {x}" for x in xs] or ["  (none)"]
    top = some([f"{c}: {n}" for c, n in stats["top_skipped_categories"]]) if stats["categories_available"] else ["  (not recorded)"]
    unknown = [f"  of unknown type: {stats['skipped_unknown']}"] if stats["skipped_unknown"] else []
    return "\n".join([
        f"Documents: {stats['documents_retained']}", f"Listed pages: {stats['pages_listed']}", "Types:", *(f"  {t}: {n}" for t, n in stats["document_type_counts"].items()),
        f"Skipped pages: {stats['skipped_total']}", *unknown, "Frequent categories of skipped pages:", *top,
        "Skipped identity pages:", *some(stats["identity_samples"]), "Skipped E.G.O. pages:", *some(stats["ego_samples"]),
    ])
