"""Gold questions and retrieval metrics."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T


def resolve_gold(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """gold (id, question, question_type, relevant_doc_ids, relevant_doc_titles) with
    resolved_ids, unresolved_ids, unresolved_titles and status. A title resolves if just
    one document has its normalised form. Order of the labels is kept."""
    by_id = gold.select("id", F.posexplode("relevant_doc_ids").alias("pos", "label")).withColumn("kind", F.lit(0)).join(docs.select(F.col("doc_id").alias("label"), F.col("doc_id").alias("found")).distinct(), "label", "left")
    one = docs.groupBy(T.title_key(F.col("title")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("found")).filter("n = 1").drop("n")
    by_title = gold.select("id", F.posexplode("relevant_doc_titles").alias("pos", "label")).withColumn("kind", F.lit(1)).withColumn("key", T.title_key(F.col("label"))).join(one, "key", "left").drop("key")
    labels = by_id.unionByName(by_title).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "label", "found"))).alias("l"))
    has = lambda kind: F.transform(F.filter("l", lambda x: (x["kind"] == kind) & x["found"].isNull()), lambda x: x["label"])
    out = gold.join(labels, "id", "left").withColumn("l", F.coalesce("l", F.array().cast(labels.schema["l"].dataType)))
    out = out.withColumn("resolved_ids", F.array_distinct(F.transform(F.filter("l", lambda x: x["found"].isNotNull()), lambda x: x["found"])))
    out = out.withColumn("unresolved_ids", has(0)).withColumn("unresolved_titles", has(1)).drop("l")
    return out.withColumn("status", resolved_status(F.size("resolved_ids"), F.size("unresolved_ids") + F.size("unresolved_titles")))


def resolved_status(resolved: Column, missing: Column) -> Column:
    return F.when(resolved == 0, "unresolved").when(missing > 0, "partial").otherwise("resolved")


def item_metrics(relevant: DataFrame, ranked: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, recall, mrr, ndcg) of relevant (query_id, doc_id) against ranked
    (query_id, doc_id, rank). Recall and nDCG are cut at k, MRR is not; a question
    without hits scores 0."""
    n = relevant.select("query_id", "doc_id").distinct()
    hit = n.join(ranked, ["query_id", "doc_id"], "left")
    gain = F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1))
    agg = hit.groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("rank") <= k, 1)).alias("got"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return agg.select("query_id", (F.col("got") / F.col("n")).alias("recall"), "mrr", (F.col("dcg") / ideal).alias("ndcg"))


def report(items: DataFrame, metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status and means over evaluated items, overall or by columns of items
    (query_id, status, ...). Unresolved items are left out of the means. A missing
    question_type counts as "other"; groups come in order."""
    rows = items.join(metrics, "query_id", "left").withColumn("on", F.col("status") != "unresolved")
    if "question_type" in rows.columns:
        rows = rows.withColumn("question_type", F.coalesce(F.nullif("question_type", F.lit("")), F.lit("other")))
    means = [F.round(F.coalesce(F.avg(F.when(F.col("on"), F.coalesce(m, F.lit(0.0)))), F.lit(0.0)), 6).alias(m) for m in ("recall", "mrr", "ndcg")]
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("resolved", "partial", "unresolved")]
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("questions"), F.count(F.when(F.col("on"), 1)).alias("evaluated"), *counts, *means)
    return out.orderBy(*by) if by else out


def unresolved_labels(resolved: DataFrame) -> DataFrame:
    """Items of ``resolve_gold`` with a label that was not found, and those labels."""
    return resolved.filter((F.size("unresolved_ids") > 0) | (F.size("unresolved_titles") > 0)).select("id", "unresolved_ids", "unresolved_titles")


def first_resolved(items: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` items (pos, id, resolved_ids, ...) that have a resolved label,
    and a row (skipped): unresolved ones before the last of these, or all if there are fewer."""
    on = F.size("resolved_ids") > 0
    taken = items.filter(on).orderBy("pos").limit(limit)
    end = taken.agg(F.count("*").alias("taken"), F.max("pos").alias("last"))
    skipped = items.filter(~on).join(end).filter((F.col("taken") < limit) | (F.col("pos") < F.col("last"))).agg(F.count("*").alias("skipped"))  # end is a row
    return taken, skipped


def arm_means(rows: DataFrame, arms: list[str], metrics: tuple[str, ...] = ("recall", "mrr", "ndcg")) -> DataFrame:
    """(arm, n, means) of rows with <arm>_<metric> columns; the means of no rows are 0."""
    out = None
    for arm in arms:
        part = rows.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(f"{arm}_{m}"), F.lit(0.0)), 6).alias(m) for m in metrics)).select(F.lit(arm).alias("arm"), "n", *metrics)
        out = part if out is None else out.unionByName(part)
    return out


def lexical_coverage(answer: Column, points: Column) -> Column:
    """Share of expected points found in the answer, case-folded and squeezed."""
    text = T.fold(answer)
    return F.when(F.size(points) > 0, F.size(F.filter(points, lambda p: F.contains(text, T.fold(p)))) / F.size(points)).otherwise(0.0)


def holding(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of all pairs in which the text of an item (item_id, text) stands
    in that of a document (doc_id, text).

    The words between an item's first and last stand whole in such a document, so it is
    looked for only where the one of them is that the fewest documents hold; items of two
    words at most, a few, in every document. Items go to the documents, whose texts and
    words are dealt to no other task."""
    asked = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").filter("text is not null").collect()]  # questions of an evaluation
    inner = {text: set(text.split()[1:-1]) for _, text in asked}
    words = set().union(*inner.values())
    texts = docs.select("doc_id", "text").filter("text is not null")

    def count(batches):
        held = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words.intersection(text.split()))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    n = {r["w"]: r["n"] for r in texts.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()} if words else {}
    by_word: dict[str, list[int]] = {}
    for k, (_, text) in enumerate(asked):
        by_word.setdefault(min(inner[text], key=lambda w: (n.get(w, 0), w), default=""), []).append(k)
    everywhere = by_word.pop("", [])
    kinds = [items.schema["item_id"].dataType, docs.schema["doc_id"].dataType]
    arrow = [to_arrow_type(x) for x in kinds]

    def look(batches):
        for batch in batches:
            found = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                likely = [k for w in by_word.keys() & set(text.split()) for k in by_word[w]]
                found += [(k, d) for k in likely + everywhere if asked[k][1] in text]
            yield pa.RecordBatch.from_arrays([pa.array([asked[k][0] for k, _ in found], arrow[0]), pa.array([d for _, d in found], arrow[1])], ["item_id", "doc_id"])

    return texts.mapInArrow(look, f"item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}")


def covering(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, coverage 1.0) of all pairs in which the folded text of an item
    (item_id, text) stands in that of a document (doc_id, text)."""
    folded = lambda df, key: df.select(key, T.fold(F.col("text")).alias("text"))
    return holding(folded(items, "item_id"), folded(docs, "doc_id")).withColumn("coverage", F.lit(1.0))


def claim_metrics(claims: DataFrame, by: list[str]) -> DataFrame:
    """Supported share of claims (supported, cited, supporting), and among those that
    cite, the share that cites something that supports them. Empty means are 0."""
    cites = F.size("cited") > 0
    return claims.groupBy(*by).agg(
        F.count("*").alias("claims"), F.coalesce(F.avg(F.col("supported").cast("double")), F.lit(0.0)).alias("supported_share"),
        F.coalesce(F.avg(F.when(cites, F.arrays_overlap("cited", "supporting").cast("double"))), F.lit(0.0)).alias("cited_right_share"),
    )


def experiment_slice(items: DataFrame, limit: int = 6) -> DataFrame:
    """Items with the fewest findings first (n_relevant 0, then id)."""
    return items.orderBy(F.col("n_relevant") != 0, "id").limit(limit)
