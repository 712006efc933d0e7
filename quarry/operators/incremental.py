"""Change feeds: latest change, need to fetch, upsert, reuse of vectors, continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.functions import text as T


def change_key() -> Column:
    """Changes (page_id, title) are of a page id, or of a folded title where that is 0."""
    return F.when(F.col("page_id") != 0, F.concat(F.lit("id:"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("title:"), T.fold(F.col("title"))))


def latest_changes(changes: DataFrame, key: Column | None = None) -> DataFrame:
    """The last change of each key by timestamp, revision, then place in the feed (pos)."""
    rows = changes.withColumn("key", change_key() if key is None else key)
    last = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), F.struct("timestamp", "revision_id", "pos")).alias("c"))
    return last.select("key", "c.*")


def watermark(latest: DataFrame, since: str) -> DataFrame:
    return latest.agg(F.coalesce(F.max("timestamp"), F.lit(since)).alias("until"))


def needs_fetch(latest: DataFrame, docs: DataFrame) -> DataFrame:
    """Changes of known ids that aren't deletions and whose page is unknown, whose
    revision is unknown (0), or newer than the stored one."""
    stored = docs.select(F.col("page_id"), F.col("revision_id").alias("stored"))
    rows = latest.filter("page_id <> 0 and not deleted").join(stored, "page_id", "left")
    return rows.filter("stored is null or revision_id = 0 or stored < revision_id")


def upserted(docs: DataFrame, latest: DataFrame, fetched: DataFrame, retained: Column | None = None) -> DataFrame:
    """docs after the changes: deleted pages go, by id or title; requested pages that
    weren't returned go; fetched pages replace stored ones, unless their type is no
    longer retained."""
    requested = needs_fetch(latest, docs).select("page_id")
    gone_ids = latest.filter("deleted and page_id <> 0").select("page_id").unionByName(requested).distinct()
    gone_titles = latest.filter("deleted and page_id = 0").select(T.fold(F.col("title")).alias("_t")).distinct()
    left = docs.join(gone_ids, "page_id", "left_anti").withColumn("_t", T.fold(F.col("title"))).join(gone_titles, "_t", "left_anti").drop("_t")
    new = fetched.join(requested, "page_id", "left_semi")
    if retained is not None:
        new = new.filter(retained)
    return left.select(docs.columns).unionByName(new.select(docs.columns))


def pending(listings: DataFrame, completed: DataFrame, existing: DataFrame, skipped: DataFrame) -> DataFrame:
    """Listings still to do: not completed (of which a document exists) and not skipped."""
    done = completed.select("page_id").intersect(existing.select("page_id")).union(skipped.select("page_id"))
    return listings.join(done.distinct(), "page_id", "left_anti")


def missing(requested: DataFrame, returned: DataFrame, key: str = "page_id") -> DataFrame:
    return requested.select(key).distinct().join(returned.select(key), key, "left_anti")


def changed_documents(old_chunks: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id): named ones, vanished ones, and those whose chunks hold another revision
    than the document, or several."""
    held = old_chunks.groupBy("doc_id").agg(F.collect_set("revision_id").alias("revs"))
    current = docs.select("doc_id", F.array("revision_id").alias("now"))
    odd = held.join(current, "doc_id", "left").filter("now is null or revs <> now").select("doc_id")
    fresh = docs.select("doc_id").join(held.select("doc_id"), "doc_id", "left_anti")
    return named.select("doc_id").union(odd).union(fresh).distinct()


def maintained(old_chunks: DataFrame, new_chunks: DataFrame, docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of unchanged documents that still exist, and the new ones."""
    kept = old_chunks.join(changed, "doc_id", "left_anti").join(docs.select("doc_id"), "doc_id", "left_semi")
    return kept.unionByName(new_chunks)


def reuse_vectors(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """chunks with their cached embedding where the text is still the same; a null one is
    to be computed."""
    c = cached.select("chunk_id", F.col("embed_text").alias("_t"), "embedding")
    return chunks.join(c, "chunk_id", "left").withColumn("embedding", F.when(F.col("_t") == F.col("embed_text"), F.col("embedding"))).drop("_t")


def history_window(turns: DataFrame, n: int = 4, most: int = 2000) -> DataFrame:
    """The last n turns that aren't blank of each conversation, cut to ``most`` characters."""
    rows = turns.filter(T.strip(F.col("text")) != "")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return rows.withColumn("back", place).filter(F.col("back") <= n).withColumn("text", F.substring("text", 1, most))
