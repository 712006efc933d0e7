"""The change feed as a stream: micro-batches upsert a versioned document table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.incremental import latest_changes, needs_fetch, upserted
from quarry.sources.store import Store


#: Parts that a versioned table is dealt into by page.
BUCKETS = 64


def _bucket(page_id: Column) -> Column:
    return F.pmod(F.hash(page_id.cast("long")), F.lit(BUCKETS))


def _write(rows: DataFrame, buckets: list[int], folder: str, version: int) -> None:
    """A version of these buckets. A row without a page marks each, so that an emptied
    bucket is known as such."""
    marks = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket int")
    for f in rows.schema:
        if f.name != "bucket":
            marks = marks.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows.unionByName(marks).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={version}")


def write_table(docs: DataFrame, folder: str) -> None:
    """Begin a versioned table with these documents (page_id, ...)."""
    _write(docs.withColumn("bucket", _bucket(F.col("page_id"))), list(range(BUCKETS)), folder, 0)


def read_table(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """The table: of each bucket its last version, up to ``until``."""
    rows = spark.read.parquet(folder)
    if until is not None:
        rows = rows.filter(F.col("version") <= until)
    last = rows.filter("page_id is null").groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi").filter("page_id is not null").drop("version")


def last_version(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(folder).agg(F.max("version")).first()[0]


def apply_changes(changes: DataFrame, folder: str, checkpoint: str, fetch: Callable[[DataFrame], DataFrame]):
    """Start a stream that, for each micro-batch of changes (page_id, title, revision_id,
    timestamp, deleted, pos), rewrites the buckets of a versioned table that the changes
    touch, and no others. A batch's version follows the one that the stream began with, so
    a replay writes the same one again; a new checkpoint begins after the last version.
    Revision comparison makes repeated changes harmless. Returns the query."""
    spark = changes.sparkSession
    store = Store(spark, f"{folder.rstrip('/')}-streams")
    name = f"base {checkpoint}"
    if store.get(name) is None:
        store.put(name, {"base": last_version(spark, folder)})
    base = store.get(name)["base"]

    def batch(rows: DataFrame, epoch: int) -> None:
        docs = read_table(spark, folder, base + epoch)
        latest = latest_changes(rows).persist()
        gone = latest.filter("deleted and page_id = 0").select(T.fold(F.col("title")).alias("_t"))
        named = docs.withColumn("_t", T.fold(F.col("title"))).join(gone, "_t", "left_semi").select("bucket")
        touched = sorted({r["bucket"] for r in latest.filter("page_id <> 0").select(_bucket(F.col("page_id")).alias("bucket")).union(named).distinct().collect()})  # BUCKETS at most
        some = docs.filter(F.col("bucket").isin(touched)).drop("bucket")
        out = upserted(some, latest, fetch(needs_fetch(latest, some).select("page_id")))
        _write(out.withColumn("bucket", _bucket(F.col("page_id"))), touched, folder, base + epoch + 1)
        latest.unpersist()

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def resume_point(state: dict, explicit: str | None = None) -> str:
    """Where to go on reading a feed: as told, else as recorded."""
    since = explicit or state.get("last_successful_change") or state.get("started_at")
    if not since:
        raise ValueError("no resume point: give one or ingest first")
    return since


def recorded(state: dict, until: str, fetched: int, deleted: int) -> dict:
    """State after indexes took the changes in; only then does the resume point move."""
    return state | {"last_successful_change": until, "last_incremental_fetched": fetched, "last_incremental_deleted": deleted}


def needs_restart(state: dict | None, restart: bool) -> bool:
    return restart or not state or state.get("status") not in ("running", "complete")


def late_free(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Changes without repeats of (page_id, revision_id) within the delay."""
    return changes.withColumn("ts", F.to_timestamp("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "revision_id"])
