"""Catalog browsing and ingest statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T
from quarry.operators.classify import TYPES, document_type

#: Rows that a task numbers, as far as the number of ranges allows.
RANGE, RANGES = 200_000, 256


def unknown_type(types: list[str]) -> str | None:
    """The least type that doesn't exist, for a request's error."""
    return min(set(types) - set(TYPES), default=None)


def bounded_limit(n: int, most: int) -> int:
    if n < 1:
        raise ValueError("limit must be positive")
    return min(n, most)


def visible(docs: DataFrame) -> DataFrame:
    return docs.filter(~T.is_media_page(F.col("title")))


def search(docs: DataFrame, types: list[str] | None = None, needle: str = "", chapter: str = "") -> DataFrame:
    """Visible documents of these types that hold the needle in title or text and carry the chapter."""
    out = visible(docs)
    if types:
        out = out.filter(F.col("document_type").isin(*types))
    if needle.strip():
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "title", "plain_text")), F.lower(F.lit(needle.strip()))))
    if chapter.strip():
        out = out.filter(F.exists("chapters", lambda c: T.fold(c) == T.fold(F.lit(chapter))))
    return out


def listed(docs: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """Documents that the catalog names."""
    return docs.join(catalog_ids.select("doc_id"), "doc_id", "left_semi")


def in_order(docs: DataFrame, folded: bool = True) -> DataFrame:
    """A corpus in its order: by title, folded after an update and as it is after a full
    ingest, then by page_id; chunks by folded title, document and ordinal."""
    title = T.fold(F.col("title")) if folded else F.col("title")
    rest = ["doc_id", "ordinal"] if "ordinal" in docs.columns else ["page_id"]
    return docs.orderBy(title, *rest)


def numbered(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with their place from 1 in the order of ``key``, a struct of columns, as
    row_number gives it. Bounds out of a sample deal the order into ranges of some
    RANGE rows; each range is numbered by a task, from the count of all before it."""
    rows = rows.withColumn("_key", key)
    n = rows.count()
    ranges = min(RANGES, -(-n // RANGE))
    bounds = []
    if ranges > 1:
        some = rows.select("_key").sample(min(1.0, 100 * ranges / n), seed=7).orderBy("_key").collect()
        bounds = [some[len(some) * k // ranges]["_key"] for k in range(1, ranges) if some]
    kinds = rows.schema["_key"].dataType.fields
    at_least = lambda b: F.col("_key") >= F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds, strict=True)))

    def place(a: int, b: int) -> Column:
        """Among ranges a to b, by halves."""
        mid = (a + b + 1) // 2
        return F.lit(a) if a == b else F.when(at_least(bounds[mid - 1]), place(mid, b)).otherwise(place(a, mid - 1))

    rows = rows.withColumn("_range", place(0, len(bounds)))
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before = F.array(*(F.lit(sum(counts.get(x, 0) for x in range(k))).cast("long") for k in range(len(bounds) + 1)))
    in_range = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    return rows.withColumn(name, F.get(before, F.col("_range")) + in_range).drop("_key", "_range")


def page(docs: DataFrame, number: int = 1, per_page: int = 24) -> DataFrame:
    """A page by folded title, then doc_id."""
    return docs.orderBy(T.fold(F.col("title")), "doc_id").offset((number - 1) * per_page).limit(per_page)


def page_count(n: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / per_page)).cast("long")


def type_counts(kept: DataFrame, skipped: DataFrame) -> DataFrame:
    return kept.select("document_type").unionByName(skipped.select("document_type")).groupBy("document_type").agg(F.count("*").alias("n"))


def top_categories(skipped: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent categories of skipped (pos, categories); ties by first appearance."""
    rows = skipped.select("pos", F.posexplode("categories").alias("at", "category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")


def sample_titles(docs: DataFrame, k: int = 5) -> DataFrame:
    """Up to k distinct titles of each type, in case-insensitive order."""
    rows = docs.select("document_type", "title").distinct()
    return rows.withColumn("n", F.row_number().over(W.partitionBy("document_type").orderBy(F.lower("title"), "title"))).filter(F.col("n") <= k)


# Types of pages that an ingest skips.
SKIPPED_TYPES = ("identity", "ego", "other")


def skipped_pages(state: dict, spark) -> tuple[DataFrame, int, bool]:
    """Skipped pages (page_id, title, document_type, categories) of an ingest's state, how
    many are unknown, and whether categories were kept. A state of the older form names
    ids alone: titles come from its listings and types from titles."""
    schema = "page_id long, title string, document_type string, categories array<string>"
    ids = sorted({int(x) for x in state.get("skipped_page_ids", [])})
    saved = state.get("skipped_documents") or []
    if saved:
        rows = spark.createDataFrame([(int(x["page_id"]) if "page_id" in x else None, str(x.get("title", "")), str(x.get("document_type", "other")), [str(c) for c in x.get("categories", [])]) for x in saved], schema)
        return rows, max(0, len(ids) - len(saved)), True
    none = F.array().cast("array<string>")
    listed = spark.createDataFrame([(int(x["page_id"]), str(x.get("title", ""))) for x in state.get("listings", []) if "page_id" in x], "page_id long, title string").dropDuplicates(["page_id"])
    rows = spark.createDataFrame([(i,) for i in ids], "page_id long").join(listed, "page_id", "left")
    rows = rows.withColumn("document_type", document_type(F.col("title"), none)).withColumn("categories", none)
    unknown = rows.filter("title is null or document_type = 'other'").count()
    return rows.filter("title is not null"), unknown, False


def ingest_stats(kept: DataFrame, skipped: DataFrame, listed: int = 0, skipped_ids: int | None = None, unknown: int = 0, has_categories: bool = True) -> dict:
    """All that is told of an ingest: numbers of documents, listed and skipped pages, of
    types, the most frequent categories and sample titles of skipped pages."""
    on = skipped.filter(F.col("document_type").isin(*SKIPPED_TYPES))
    known = on if has_categories else on.filter("document_type <> 'other'")
    types = {r["document_type"]: r["n"] for r in type_counts(kept, known).collect()}  # a dozen at most
    samples = {r: [] for r in ("identity", "ego")}
    for r in sample_titles(skipped.filter("document_type in ('identity', 'ego') and title <> ''")).orderBy("n").collect():
        samples[r["document_type"]].append(r["title"])
    top = top_categories(on.select(F.col("page_id").alias("pos"), "categories"))
    return {
        "documents_retained": kept.count(), "pages_listed": listed, "document_type_counts": dict(sorted(types.items())), "skipped_total": skipped.count() if skipped_ids is None else skipped_ids,
        "skipped_unknown": unknown, "top_skipped_categories": [(r["category"], r["n"]) for r in top.collect()], "categories_available": has_categories,
        "identity_samples": samples["identity"], "ego_samples": samples["ego"],
    }


def stats_of_state(kept: DataFrame, state: dict) -> dict:
    rows, unknown, has = skipped_pages(state, kept.sparkSession)
    return ingest_stats(kept, rows, len(state.get("listings", [])), len({int(x) for x in state.get("skipped_page_ids", [])}), unknown, has)


def checksum(chunks: DataFrame) -> DataFrame:
    """Order-independent digest of (id, embed_text): count and the sums of two 32-bit
    words of each row's sha256, so that no row order and no single task is needed."""
    h = F.sha2(F.concat(F.col("id").cast("string"), F.lit("\x02"), F.col("embed_text")), 256)
    word = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("long"))
    return chunks.agg(F.count("*").alias("n"), word(1).alias("a"), word(9).alias("b"))
