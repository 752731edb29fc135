"""Paged services as a Spark data source (S12-S17, S19): one partition per query, each read backwards in time page by page.

The transport is a function named by the option `fetch` ("module:function"), called with (query, after, before, limit) and
returning a list of records, newest first, older than `before` and not older than `after`, both in seconds.  With the option
`settings`, a JSON object, it is also given that.  Nothing here opens a connection, so that any service of `services`, or a
folder of files, can stand behind it."""

from __future__ import annotations

import datetime as dt
import functools
import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[str, int, int, int], list[dict]]


@dataclass
class Query(InputPartition):
    text: str
    after: int
    before: int


class PagedPosts(DataSource):
    """Options: fetch, queries (a JSON list), after, before, page (100), retries (4), wait (20, seconds, times the attempt),
    budget (pages per query; none by default).  Rows: query, id, created_utc, raw (the record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "query string, id string, created_utc bigint, raw string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Query]:
        return [Query(q, int(self.options["after"]), int(self.options["before"])) for q in json.loads(self.options["queries"])]

    def read(self, partition: Query) -> Iterator[tuple]:
        return records(self.options, partition)


class PagedStream(DataSourceStreamReader):
    """The same queries as a stream: what came up to an offset has been read, what came since is to be read (S19, ST7, ST8).

    The offset is one second for each query and lives in the stream's checkpoint.  What lies between two offsets is planned
    month by month, a partition for each query and month, so that a task that is lost asks for one month again.  A query that
    joins the list later begins at `after`.  Options besides those above: `before` (by default now, less `lag` seconds, 0)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def _offset(self, second: int) -> dict:
        return {q: second for q in json.loads(self.options["queries"])}

    def initialOffset(self) -> dict:
        return self._offset(int(self.options["after"]))

    def latestOffset(self) -> dict:
        return self._offset(int(self.options.get("before", time.time() - float(self.options.get("lag", 0)))))

    def partitions(self, start: dict, end: dict) -> list[Query]:
        first = int(self.options["after"])
        return [Query(q, a, b) for q in sorted(end) for a, b in months(int(start.get(q, first)), int(end[q]))]

    def read(self, partition: Query) -> Iterator[tuple]:
        return records(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


def months(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The seconds from start to before end, cut where months (UTC) begin."""
    while start < end:
        day = dt.datetime.fromtimestamp(start, dt.timezone.utc)
        following = int(dt.datetime(day.year + day.month // 12, day.month % 12 + 1, 1, tzinfo=dt.timezone.utc).timestamp())
        yield start, min(following, end)
        start = following


def records(o: dict[str, str], part: Query) -> Iterator[tuple]:
    module, function = o["fetch"].split(":")
    fetch = getattr(importlib.import_module(module), function)
    if "settings" in o:
        fetch = functools.partial(fetch, settings=json.loads(o["settings"]))
    budget = int(o["budget"]) if "budget" in o else None
    for r in pages(fetch, part.text, part.after, part.before, int(o.get("page", 100)), int(o.get("retries", 4)), float(o.get("wait", 20)), budget):
        yield part.text, str(r["id"]), int(r["created_utc"]), json.dumps(r, sort_keys=True)


def pages(fetch: Fetch, query: str, after: int, before: int, page: int, retries: int = 4, wait: float = 20, budget: int | None = None) -> Iterator[dict]:
    """All records of a query, each id once.  The oldest second of a page is asked for again, as more of its records may follow;
    ids are remembered for that second only.  Where a second alone fills a page, the service can't give the rest of it."""
    edge: set[str] = set()
    spent = 0
    while budget is None or spent < budget:
        rows = attempt(fetch, query, after, before, page, retries, wait)
        spent += 1
        fresh = [r for r in rows if str(r.get("id", "")) and str(r["id"]) not in edge]
        yield from fresh
        if len(rows) < page:
            return
        oldest = min(int(r["created_utc"]) for r in rows)
        at_edge = {str(r["id"]) for r in rows if int(r["created_utc"]) == oldest}
        stuck = oldest + 1 >= before
        before = oldest if stuck else oldest + 1
        edge = set() if stuck else at_edge


def attempt(fetch: Fetch, query: str, after: int, before: int, page: int, retries: int, wait: float) -> list[dict]:
    """A page; after `retries` failures the error goes on, so that Spark runs the task again instead of losing records."""
    for i in range(1, retries + 1):
        try:
            return fetch(query, after, before, page)
        except OSError:
            if i == retries:
                raise
            time.sleep(wait * i)
    return []
