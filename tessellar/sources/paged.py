"""A paged REST source through Spark's Python data source API: one partition for a range of pages.

No item is lost without a sign: every page of the total that the service names is read, a short page in the
middle doesn't end a range. Requests are dealt to tasks while planning (`maxrequests`) and used up by attempts, retries among
them, so a failing service sees no more than allowed (a task that Spark runs again has its share again: keep incomplete
reads, which fail no task, where the bound must be strict). What is missing in the end fails the read, or, with `onincomplete` set to
`keep`, stands in the statistics (`crawl_stats`).
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds before each of the retries.
WAITS = (2.0, 4.0, 8.0)


class BudgetSpent(RuntimeError):
    """No request is left."""


class Budget:
    """Requests that may still be made; without a limit if most is None. Every attempt uses one up."""

    def __init__(self, most: int | None = None):
        self.most, self.used = most, 0

    @property
    def left(self) -> int | None:
        return None if self.most is None else self.most - self.used

    def spend(self) -> None:
        if self.left is not None and self.left <= 0:
            raise BudgetSpent(f"all {self.most} requests are used up")
        self.used += 1


def shares(most: int, weights: list[int]) -> list[int]:
    """most as whole parts in proportion to the weights: the largest remainders get what rounding leaves."""
    total = sum(weights) or 1
    out = [most * w // total for w in weights]
    for k in sorted(range(len(weights)), key=lambda k: (-(most * weights[k] % total), k))[: most - sum(out)]:
        out[k] += 1
    return out


def fetch(url: str, opener=urllib.request.urlopen, waits: tuple[float, ...] = WAITS, sleep=time.sleep, budget: Budget | None = None) -> str:
    """The body; server errors, 429 and broken connections are tried again. Every attempt is paid for first."""
    for wait in (*waits, None):
        if budget is not None:
            budget.spend()
        try:
            with opener(url, timeout=30) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if wait is None or e.code != 429 and e.code < 500:
                raise
        except (urllib.error.URLError, TimeoutError):
            if wait is None:
                raise
        sleep(wait)
    raise AssertionError("unreachable")


def unwrap(text: str) -> tuple[list[dict], int]:
    """(items, total count) of an envelope with response.body or body; one item may stand without a list."""
    value = json.loads(text)
    value = value.get("response", value)
    code = str(value.get("header", {}).get("resultCode", "00"))
    if code not in ("0", "00", "200"):
        raise ValueError(f"result code {code}")
    body = value.get("body", {})
    items = body.get("items") or []
    if isinstance(items, dict):
        items = items.get("item") or []
    return ([items] if isinstance(items, dict) else list(items)), int(body.get("totalCount") or 0)


@dataclass(frozen=True)
class SearchPage:
    """What one page of search results says about all of them."""

    items: list[dict]
    total: int
    total_media: int
    total_pages: int


def search_page(text: str, rows: int) -> SearchPage:
    """A result page: its items, the counts of documents and media, and the pages that hold `rows` items each."""
    items, total = unwrap(text)
    value = json.loads(text)
    body = value.get("response", value).get("body", {})
    media = int(body.get("totalMediaCount") or body.get("totalMedia") or 0)
    return SearchPage(items, total, media, max(1, math.ceil(total / rows)))


def crawl_stats(items: DataFrame, total: int, size: int, pages_allowed: int | None = None) -> DataFrame:
    """One row for a crawl (page, place, item): total, fetched, pages, complete and the reason why it stopped.

    complete: all were fetched; budget: the pages allowed hold no more; short: items are missing from pages read.
    """
    counted = items.where("page is not null").agg(F.count("*").alias("fetched"), F.countDistinct("page").alias("pages"))
    complete = F.col("fetched") >= total
    allowed = total if pages_allowed is None else min(total, pages_allowed * size)
    reason = F.when(complete, "complete").when((F.col("fetched") >= allowed), "budget").otherwise("short")
    return counted.select(F.lit(total).cast("long").alias("total"), "fetched", "pages", complete.alias("complete"), reason.alias("stop_reason"))


def budget_left(rows: DataFrame) -> DataFrame:
    """One row for a crawl read with `reportbudget`: requests used and left, and the tasks that stopped early."""
    own = rows.where("page is null").select("place", F.from_json("item", "used int, stopped string").alias("r"))
    return own.agg(F.sum("r.used").alias("used"), F.sum("place").alias("left"), F.count("r.stopped").alias("stopped"))


def error_class(body: Column) -> Column:
    """json, html or xml error page, or empty."""
    head = F.lower(F.ltrim(body))
    return F.when(F.coalesce(head, F.lit("")) == "", "empty").when(head.startswith("{") | head.startswith("["), "json").when(head.contains("<html"), "html").when(head.startswith("<"), "xml").otherwise("text")


class Pages(InputPartition):
    def __init__(self, first: int, last: int, total: int, requests: int | None):
        self.first, self.last, self.total, self.requests = first, last, total, requests


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]  # with {page} and {size}
        self.size = int(options.get("pagesize", 100))
        #: The request budget: pages, besides the first request for the total.
        self.most = int(options["maxpages"]) if "maxpages" in options else None
        self.together = int(options.get("pagespertask", 10))
        #: Requests of the whole crawl, retries and the one for the total among them.
        self.requests = int(options["maxrequests"]) if "maxrequests" in options else None
        self.waits = tuple(float(w) for w in options["waits"].split(",") if w) if "waits" in options else WAITS
        self.report = str(options.get("reportbudget", "false")).lower() == "true"
        self.keep = str(options.get("onincomplete", "fail")).lower() == "keep"

    def partitions(self) -> list[InputPartition]:
        budget = Budget(self.requests)
        _, total = unwrap(fetch(self.url.format(page=1, size=1), waits=self.waits, budget=budget))
        pages = math.ceil(total / self.size)
        if self.most is not None and pages > self.most:
            if not self.keep:
                raise ValueError(f"{pages} pages exceed the budget of {self.most}; set onincomplete to keep for the first ones")
            pages = self.most
        ranges = [(p, min(p + self.together - 1, pages)) for p in range(1, pages + 1, self.together)] or [(1, 0)]
        dealt = [None] * len(ranges) if budget.left is None else shares(budget.left, [b - a + 1 for a, b in ranges])
        return [Pages(a, b, total, n) for (a, b), n in zip(ranges, dealt, strict=True)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """Items as (page, place, item); with `reportbudget` a task ends with a row (null, requests left, what it used and why it stopped)."""
        budget, reason = Budget(partition.requests), None
        for page in range(partition.first, partition.last + 1):
            try:
                items, _ = unwrap(fetch(self.url.format(page=page, size=self.size), waits=self.waits, budget=budget))
            except (BudgetSpent, urllib.error.URLError, TimeoutError) as e:
                if not self.keep:
                    raise
                reason = f"page {page}: {type(e).__name__}"
                break
            due = min(self.size, partition.total - (page - 1) * self.size)
            if len(items) < due and not self.keep:
                raise ValueError(f"page {page} holds {len(items)} items instead of {due}")
            for place, item in enumerate(items):
                yield page, place, json.dumps(item, ensure_ascii=False, sort_keys=True)
        if self.report:
            yield None, budget.left, json.dumps({"used": budget.used, "stopped": reason}, sort_keys=True)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("url", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, place int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
