"""Resumable ingest of a whole source: a listing frozen once, batches of pages, and a
record of what is done after each, so that a run that ends early goes on where it was."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators.classify import is_retained
from quarry.sources.api import Source, compact_stamp, now_stamp
from quarry.sources.pages import documents, is_missing
from quarry.sources.store import Store
from quarry.streaming.changes import needs_restart, recorded, resume_point


class Ingest:
    """State is records and tables of a store: the listing, a folder of documents and one
    of skipped pages for each batch, written over if the batch is done again."""

    def __init__(self, store: Store, source: Source, batch: int = 50, retained_only: bool = True):
        self.store, self.source, self.batch, self.retained_only = store, source, max(1, batch), retained_only

    def state(self) -> dict | None:
        return self.store.get("ingest")

    def _begun(self, restart: bool) -> dict:
        """The state to go on with. The start is taken before the listing, so that changes
        made while pages are listed aren't missed later."""
        state = self.state()
        if not needs_restart(state, restart):
            return state
        began = now_stamp()
        listing = self.store.save("listing", self.source.list_pages())
        state = {"run": compact_stamp() + f"-{(state or {}).get('number', 0) + 1}", "number": (state or {}).get("number", 0) + 1, "started_at": began, "status": "running", "batches": 0, "listed": listing.count()}
        self.store.put("ingest", state)
        return state

    def _table(self, state: dict, name: str) -> DataFrame | None:
        try:
            return self.store.spark.read.parquet(f"{self.store.folder}/{name}-{state['run']}")
        except AnalysisException as e:
            if is_missing(e):
                return None
            raise

    def pending(self, state: dict) -> DataFrame:
        """Listed pages that no batch has taken, in order."""
        left = self.store.load("listing")
        for name in ("kept", "skipped"):
            done = self._table(state, name)
            if done is not None:
                left = left.join(done.filter(F.col("batch") < state["batches"]).select("page_id"), "page_id", "left_anti")
        return left.orderBy("title", "page_id")

    def run(self, restart: bool = False, most_batches: int | None = None) -> DataFrame:
        """Take all pending pages, batch by batch, and return the documents by title and
        page_id. A complete ingest is left as it is. A page that the source doesn't return
        is an error, and its batch isn't recorded."""
        state = self._begun(restart)
        if state["status"] == "complete":
            return self.documents()
        ids = [r["page_id"] for r in self.pending(state).select("page_id").toLocalIterator()]
        for n, a in enumerate(range(0, len(ids), self.batch)):
            if n == most_batches:
                return self.documents()
            some = ids[a : a + self.batch]
            docs = documents(self.source.fetch_pages(some)).withColumn("batch", F.lit(state["batches"]))
            keep = is_retained(F.col("document_type")) if self.retained_only else F.lit(True)
            folder = lambda name: f"{self.store.folder}/{name}-{state['run']}/batch={state['batches']}"
            docs.drop("batch").write.mode("overwrite").parquet(f"{self.store.folder}/fetched")
            got = self.store.spark.read.parquet(f"{self.store.folder}/fetched")
            missing = sorted(set(some) - {r["page_id"] for r in got.select("page_id").collect()})  # a batch
            if missing:
                raise RuntimeError(f"the source did not return pages {missing}")
            got.filter(keep).write.mode("overwrite").parquet(folder("kept"))
            got.filter(~keep).select("page_id", "title", "document_type", "categories").write.mode("overwrite").parquet(folder("skipped"))
            state = state | {"batches": state["batches"] + 1}
            self.store.put("ingest", state)
        self.store.put("ingest", state | {"status": "complete", "last_successful_change": state["started_at"]})
        return self.documents()

    def documents(self) -> DataFrame:
        state = self.state() or {"run": "none", "batches": 0}
        kept = self._table(state, "kept")
        return None if kept is None else C.in_order(kept.filter(F.col("batch") < state["batches"]).drop("batch"), folded=False)

    def stats(self) -> dict:
        state = self.state() or {"run": "none", "listed": 0}
        skipped = self._table(state, "skipped")
        return C.ingest_stats(self.documents(), skipped, state["listed"])

    def since(self, explicit: str | None = None) -> str:
        return resume_point(self.state() or {}, explicit)

    def commit(self, until: str, fetched: int, deleted: int) -> None:
        """Move the resume point. To be called when indexes have taken the changes in."""
        self.store.put("ingest", recorded(self.state() or {}, until, fetched, deleted))
