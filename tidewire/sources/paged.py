"""Paged feeds as a data source: ``spark.read.format("paged_feed")``.

An upstream answers for one account and one window (``24h``, ``7d``, ``30d`` or
``all``) with a page of items and an opaque cursor for the next.  Each account is
a partition, since its cursors form a chain; accounts are read side by side and
rows leave page by page.  A lower bound on ``published_at`` is pushed down: it
picks the smallest window that covers it, and Spark filters the rest.

``limited`` answers (the upstream cools down) end an account with the pages that
came before; any other refusal, and a page that is no JSON, fails the read (or,
with ``onFailure`` = ``keep``, ends the account likewise, with a row that names
the failure); an account without captured pages has no rows.

Pages come from a folder of captures, ``<account>/<window>/<number>.json``, in
which the file ``0`` is the first page and a cursor names the next file; a window
that wasn't captured is read from ``all``.  Options: ``path``, ``accounts``
(JSON list), ``now`` (the moment that windows count from), ``maxPages`` (where it
is given, a longer feed is a failure), ``onFailure``.  A cursor that comes again
is a failure, so circles end without a limit on the number of pages.

As a stream each micro-batch takes the pages of captures that are new: the
offset of an account is the number of its ``all`` pages read so far.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "account string, page int, position int, title string, url string, summary string, published_at timestamp, window string, failure string"
#: Windows of the upstream by days, smallest first.
WINDOWS = ((1, "24h"), (7, "7d"), (30, "30d"))


def smallest_window(since: datetime | None, now: datetime) -> str:
    """The name of the smallest window that reaches back to ``since``."""
    if since is not None:
        for days, name in WINDOWS:
            if now - timedelta(days=days) <= since:
                return name
    return "all"


def _local(path: str) -> str:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme else path


def _moment(text) -> datetime | None:
    try:
        found = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


@dataclass
class Account(InputPartition):
    name: str
    window: str
    first: int = 0
    last: int | None = None


class Refused(Exception):
    """The upstream's answer is no page."""


class Captures:
    """Pages of accounts in a folder."""

    def __init__(self, options: dict):
        self.root = _local(options["path"])  # names of options come in lower case
        self.most = int(options["maxpages"]) if "maxpages" in options else None
        self.keeps = options.get("onfailure", "fail") == "keep"

    def folder(self, account: Account) -> str | None:
        for window in (account.window, "all"):
            folder = os.path.join(self.root, account.name, window)
            if os.path.isdir(folder):
                return folder
        return None

    def numbers(self, name: str) -> int:
        folder = os.path.join(self.root, name, "all")
        return sum(f.endswith(".json") for f in os.listdir(folder)) if os.path.isdir(folder) else 0

    def pages(self, account: Account) -> Iterator[tuple[int, list[dict]]]:
        """(number, items) along the cursors; a cool-down ends them."""
        folder, cursor, page = self.folder(account), str(account.first), account.first
        met: set[str] = set()
        while folder is not None and (account.last is None or page < account.last):
            if self.most is None and cursor in met:
                raise Refused(f"cursor {cursor} comes again")
            if self.most is not None and page - account.first >= self.most:
                raise Refused(f"more than {self.most} pages")
            met.add(cursor)
            try:
                with open(os.path.join(folder, f"{cursor}.json"), encoding="utf-8") as f:
                    answer = json.load(f)
            except FileNotFoundError:
                if page == account.first and not account.first:
                    return
                raise Refused(f"no page {cursor}") from None
            except ValueError:
                raise Refused(f"page {cursor} is no JSON") from None
            if not answer.get("ok"):
                error = answer.get("error") or {}
                if error.get("code") == "RATE_LIMITED":
                    return
                raise Refused(f"{error.get('code')}: {error.get('message')}")
            yield page, (answer.get("data") or {}).get("items") or []
            meta = answer.get("meta") or {}
            cursor, page = meta.get("next_cursor"), page + 1
            if not meta.get("has_more") or not cursor:
                return

    def rows(self, account: Account) -> Iterator[tuple]:
        at = account.first
        try:
            for at, items in self.pages(account):
                for position, item in enumerate(items):
                    yield (account.name, at, position, item.get("title"), item.get("url"), item.get("summary"), _moment(item.get("published_at")), account.window, None)
        except Refused as refused:
            if not self.keeps:
                raise
            yield (account.name, at, None, None, None, None, None, account.window, str(refused))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.now = _moment(options["now"]) if "now" in options else datetime.now(timezone.utc)
        self.since: datetime | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the name is Spark's
        """Lower bounds on the time pick a window; Spark still applies them all."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("published_at",) and isinstance(f.value, datetime):
                bound = f.value if f.value.tzinfo else f.value.astimezone(timezone.utc)
                self.since = bound if self.since is None else max(self.since, bound)
            yield f

    def partitions(self) -> list[Account]:
        window = smallest_window(self.since, self.now)
        return [Account(name, window) for name in json.loads(self.options["accounts"])]

    def read(self, partition: Account) -> Iterator[tuple]:
        return Captures(self.options).rows(partition)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.names = json.loads(options["accounts"])

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.names, 0)

    def latestOffset(self) -> dict:  # noqa: N802
        captures = Captures(self.options)
        return {name: captures.numbers(name) for name in self.names}

    def partitions(self, start: dict, end: dict) -> list[Account]:
        return [Account(name, "all", start.get(name, 0), upto) for name, upto in end.items() if upto > start.get(name, 0)]

    def read(self, partition: Account) -> Iterator[tuple]:
        return Captures(self.options).rows(partition)


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeed)
