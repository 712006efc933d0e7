"""A polite page API as a Spark data source: the caller gives the transport."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = {429, 500, 502, 503, 504}


def retry_delay(attempt: int, retry_after: str | None, now: float) -> float:
    """Seconds to wait: as told, in seconds or by date, else doubling up to a minute."""
    if retry_after:
        try:
            return max(0.0, float(retry_after))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(retry_after).timestamp() - now)
            except (TypeError, ValueError):
                pass
    return min(2.0**attempt, 60.0)


class PoliteClient:
    """Calls ``get(params) -> (status, headers, body)`` at most once an interval, and
    again on transport errors and retryable statuses."""

    def __init__(self, get: Callable, interval: float = 1.0, attempts: int = 5, sleep=time.sleep, clock=time.time):
        self.get, self.interval, self.attempts, self.sleep, self.clock, self.last = get, interval, attempts, sleep, clock, None

    def __call__(self, params: dict) -> dict:
        for attempt in range(self.attempts + 1):
            if self.last is not None and (wait := self.last + self.interval - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                status, headers, body = self.get(params)
            except OSError:
                if attempt == self.attempts:
                    raise
                self.sleep(retry_delay(attempt, None, self.clock()))
                continue
            if status < 400:
                return body
            if status not in RETRIED or attempt == self.attempts:
                raise RuntimeError(f"the API answered {status}")
            self.sleep(retry_delay(attempt, headers.get("Retry-After"), self.clock()))
        raise RuntimeError("unreachable")

    def pages(self, params: dict) -> Iterator[dict]:
        """All responses along continuation tokens."""
        token: dict = {}
        while True:
            body = self({**params, **token})
            yield body
            token = body.get("continue") or {}
            if not token:
                return


@runtime_checkable
class Source(Protocol):
    """What an ingest reads: a listing (page_id, title, namespace) and pages by id.
    ``recent_changes(since)`` is there only for sources that can tell changes."""

    def list_pages(self) -> DataFrame: ...

    def fetch_pages(self, ids: list[int]) -> DataFrame: ...


CHANGE = "page_id long, title string, revision_id long, timestamp string, deleted boolean"
LISTING = "page_id long, title string, namespace int"


def compact_stamp(at: datetime | None = None) -> str:
    """A time as digits, for names of runs."""
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def now_stamp() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def ordered_changes(changes: DataFrame) -> DataFrame:
    """Changes in feed order with their place: by time, page, folded title and revision."""
    from quarry.functions import text as T

    key = F.struct("timestamp", "page_id", T.fold(F.col("title")).alias("t"), "revision_id")
    return changes.withColumn("pos", key).orderBy("pos")


class ApiSource:
    """A site's API as a source: categories walked to a depth, pages in batches, the feed
    of changes. All answers along continuation tokens are read, one call an interval."""

    def __init__(self, spark: SparkSession, client: PoliteClient, categories: list[str], depth: int = 2, batch: int = 50):
        self.spark, self.client, self.categories, self.depth, self.batch = spark, client, categories, depth, batch

    def list_pages(self) -> DataFrame:
        waiting, seen, found = [(c, 0) for c in self.categories], set(), {}
        while waiting:
            name, depth = waiting.pop(0)
            name = name if name.startswith("Category:") else f"Category:{name}"
            if name in seen:
                continue
            seen.add(name)
            asked = {"action": "query", "list": "categorymembers", "cmtitle": name, "cmnamespace": "0|14", "cmtype": "page|subcat", "cmlimit": "max"}
            for body in self.client.pages(asked):
                for x in body.get("query", {}).get("categorymembers", []):
                    if x.get("ns", 0) == 0:
                        found[x["pageid"]] = (x["pageid"], x["title"], 0)
                    elif x["ns"] == 14 and depth < self.depth:
                        waiting.append((x["title"], depth + 1))
        return self.spark.createDataFrame(sorted(found.values(), key=lambda x: (x[1], x[0])), LISTING)

    def recent_changes(self, since: str) -> DataFrame:
        """Edits, new pages and deletions from ``since`` on, itself included, in order."""
        asked = {"action": "query", "list": "recentchanges", "rcnamespace": "0", "rctype": "edit|new|log", "rcprop": "title|ids|timestamp|loginfo", "rcstart": since, "rcdir": "newer", "rclimit": "max"}
        rows = []
        for body in self.client.pages(asked):
            for x in body.get("query", {}).get("recentchanges", []):
                gone = (x.get("type"), x.get("logtype")) == ("log", "delete")
                rows.append((int(x.get("pageid") or 0), str(x.get("title", "")), int(x.get("revid") or 0), str(x.get("timestamp", "")), gone))
        return ordered_changes(self.spark.createDataFrame(rows, CHANGE))

    def fetch_pages(self, ids: list[int]) -> DataFrame:
        """Page rows in the order asked for, at place ``asked``; missing pages have none.
        Category lists that came in several answers are one."""
        from quarry.sources.pages import merged_categories, page_from_json

        rows = []
        for a in range(0, len(ids), self.batch):
            asked = {"action": "query", "pageids": "|".join(map(str, ids[a : a + self.batch])), "prop": "revisions|categories|info", "rvslots": "main", "rvprop": "ids|timestamp|content", "inprop": "url", "cllimit": "max"}
            for part, body in enumerate(self.client.pages(asked)):
                pages = body.get("query", {}).get("pages") or []
                rows += [(a + part, json.dumps(x)) for x in (pages.values() if isinstance(pages, dict) else pages) if not x.get("missing", "missing" in x)]
        raw = self.spark.createDataFrame(rows, "part int, json string")
        parts = page_from_json(raw, "part")
        first = parts.groupBy("page_id").agg(F.min_by(F.struct(*[c for c in parts.columns if c not in ("page_id", "part", "categories")]), "part").alias("p")).select("page_id", "p.*")
        order = self.spark.createDataFrame(list(enumerate(ids)), "asked int, page_id long")
        return order.join(first.join(merged_categories(parts), "page_id"), "page_id").orderBy("asked")

    def fetch_page(self, page_id: int) -> DataFrame:
        page = self.fetch_pages([page_id])
        if page.isEmpty():
            raise KeyError(f"page {page_id} is missing")
        return page


class TableSource:
    """A table of pages as a source, for dumps and fixtures. Nothing is read for a listing
    but ids and titles; pages of a batch are a join."""

    def __init__(self, pages: DataFrame, changes: DataFrame | None = None):
        self.pages, self.changes = pages, changes

    def list_pages(self) -> DataFrame:
        return self.pages.select(F.col("page_id").cast("long").alias("page_id"), "title", "namespace").orderBy("title", "page_id")

    def fetch_pages(self, ids: list[int]) -> DataFrame:
        order = self.pages.sparkSession.createDataFrame(list(enumerate(ids)), "asked int, page_id long")
        return order.join(self.pages, "page_id").orderBy("asked")

    def recent_changes(self, since: str) -> DataFrame:
        return ordered_changes(self.changes.filter(F.col("timestamp") >= since))


class PageSource(DataSource):
    """spark.read.format("polite_pages").option("ids", "1,2,3"): API pages as JSON rows.
    One partition, so that the rate limit holds for the whole read."""

    transport: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "polite_pages"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        ids = [x for x in self.options.get("ids", "").split(",") if x]
        return _Reader(ids, type(self).transport, int(self.options.get("batch", "50")), float(self.options.get("interval", "1")))


class _Reader(DataSourceReader):
    def __init__(self, ids, transport, batch, interval):
        self.ids, self.transport, self.batch, self.interval = ids, transport, batch, interval

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        client = PoliteClient(self.transport, self.interval)
        for a in range(0, len(self.ids), self.batch):
            for body in client.pages({"action": "query", "pageids": "|".join(self.ids[a : a + self.batch])}):
                for page in (body.get("query", {}).get("pages") or {}).values():
                    if "missing" not in page:
                        yield (json.dumps(page),)
