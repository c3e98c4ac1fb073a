"""Paged feeds: cursors, windows, failures, pushed filters and streams."""

import json
import os
from datetime import datetime, timezone

import pytest

from tidewire.sources import paged

NOW = "2024-03-01T00:00:00Z"


def capture(root, account, pages, window="all", start=0):
    folder = os.path.join(root, account, window)
    os.makedirs(folder, exist_ok=True)
    for n, page in enumerate(pages, start):
        with open(os.path.join(folder, f"{n}.json"), "w") as f:
            f.write(page if isinstance(page, str) else json.dumps(page))


def page(items, cursor=None):
    return {"ok": True, "data": {"items": [{"title": t, "url": f"u{t}", "published_at": p} for t, p in items]}, "meta": {"has_more": cursor is not None, "next_cursor": cursor}}


def feed(spark, root, accounts, **options):
    paged.register(spark)
    reader = spark.read.format("paged_feed").option("path", f"file://{root}").option("accounts", json.dumps(accounts)).option("now", NOW)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_cursors_windows_and_pushdown(spark, tmp_path):
    old, new = "2024-01-01T00:00:00Z", "2024-02-29T12:00:00Z"
    capture(tmp_path, "a", [page([("1", new), ("2", None)], "1"), page([("3", old)], "2"), page([])])
    capture(tmp_path, "a", [page([("1", new)])], window="24h")
    capture(tmp_path, "b", [page([("9", new), ("8", old)])])
    df = feed(spark, tmp_path, ["a", "b", "none"])
    assert sorted((r.account, r.page, r.position, r.title, r.window) for r in df.collect()) == [
        ("a", 0, 0, "1", "all"), ("a", 0, 1, "2", "all"), ("a", 1, 0, "3", "all"), ("b", 0, 0, "9", "all"), ("b", 0, 1, "8", "all")]
    recent = df.where("published_at >= timestamp'2024-02-29 06:00:00'")
    assert sorted((r.account, r.title, r.window) for r in recent.collect()) == [("a", "1", "24h"), ("b", "9", "24h")]  # b's day comes from all
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "published_at" in plan and "BatchScan" in plan


@pytest.mark.parametrize(("since", "name"), [(None, "all"), ("2024-02-29T00:00:00Z", "24h"), ("2024-02-28T23:59:59Z", "7d"), ("2024-02-01T00:00:00Z", "30d"), ("2023-01-01T00:00:00Z", "all")])
def test_smallest_window(since, name):
    assert paged.smallest_window(paged._moment(since) if since else None, datetime(2024, 3, 1, tzinfo=timezone.utc)) == name


def test_cool_down_keeps_and_failures_fail(spark, tmp_path):
    limited, broken = {"ok": False, "error": {"code": "RATE_LIMITED"}}, {"ok": False, "error": {"code": "BAD", "message": "m"}}
    capture(tmp_path, "l", [page([("1", None)], "1"), limited])
    capture(tmp_path, "x", [page([("2", None)], "1"), broken])
    capture(tmp_path, "j", [page([("3", None)], "1"), "no json"])
    capture(tmp_path, "o", [page([("4", None)], "0")])
    assert [r.title for r in feed(spark, tmp_path, ["l"]).collect()] == ["1"]
    for account in ("x", "j"):
        with pytest.raises(Exception, match="BAD|no JSON"):
            feed(spark, tmp_path, [account]).collect()
    kept = feed(spark, tmp_path, ["l", "x", "j", "o"], onFailure="keep", maxPages=3).collect()
    assert sorted((r.account, r.title) for r in kept if not r.failure) == [("j", "3"), ("l", "1"), ("o", "4"), ("o", "4"), ("o", "4"), ("x", "2")]
    assert {r.account: r.failure for r in kept if r.failure} == {"x": "BAD: m", "j": "page 1 is no JSON", "o": "more than 3 pages"}


def test_stream_takes_new_pages_once(spark, tmp_path):
    capture(tmp_path / "in", "a", [page([("1", None)], "1")])
    paged.register(spark)

    def run():
        stream = spark.readStream.format("paged_feed").option("path", f"{tmp_path}/in").option("accounts", '["a", "b"]').load()
        stream.select("account", "title").writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.account, r.title) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("a", "1")]
    capture(tmp_path / "in", "a", [page([("2", None)])], start=1)
    capture(tmp_path / "in", "b", [page([("3", None)])])
    assert run() == [("a", "1"), ("a", "2"), ("b", "3")]
    assert run() == [("a", "1"), ("a", "2"), ("b", "3")]
