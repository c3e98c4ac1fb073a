"""The stream and the queries of events at work against loops over the tables."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_event_store import GROUPS, expected_view, fixture, frames, slow, slow_merges, view
from tests.test_gray_band import slow as slow_groups
from tidewire.operators import event_store
from tidewire.plans import bindings as B
from tidewire.plans import events_at_work as work
from tidewire.plans.registry import QUERIES
from tidewire.streaming import event_stream

SF = "/root/testdata/sf0.001"


def test_stream_with_late_rows_equals_the_loop(spark, tmp_path, monkeypatch):
    articles, groups = fixture(3, 60, 36)
    batches = [groups[:12], groups[14:26], groups[26:] + groups[12:14]]  # two come late
    batches[2] = sorted(batches[2], key=lambda g: g[1])
    for batch in batches:
        spark.createDataFrame(batch, GROUPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path, facts = f"file://{tmp_path}/events", frames(spark, articles)
    stream = spark.readStream.schema(GROUPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = event_stream.take_groups(stream, path, f"{tmp_path}/c", facts, threshold=0.9, window_hours=72, parts=2)
    run.awaitTermination()
    events, _ = slow(articles, batches, 0.9, 72)
    assert view(event_stream.stored_events(spark, path).collect()) == expected_view(events)
    names = [name for _, _, name in event_stream._folders(spark, path)]
    assert len(names) == 1 and names[0].startswith("all=")  # the third batch wrote all
    again = spark.createDataFrame(batches[2], GROUPS)
    sink = event_stream.event_sink(path, facts, threshold=0.9, window_hours=72)
    sink(again, 7)
    sent = [name for _, _, name in event_stream._folders(spark, path)]
    sink(again, 7)  # sent again: nothing happens
    assert [name for _, _, name in event_stream._folders(spark, path)] == sent and len(sent) == 2


def test_stored_events_query(spark):
    articles = {r.article_id: (r.article_id, r.published_at, r.source_key, r["keys"], r.vec, r.can_be_main, r.role, r.tier) for r in work.articles_of(spark, SF).collect()}
    rows = work.groups_of(spark, SF).collect()
    batches = [[(r.group_id, r.ord, r.main_article_id, r.title, "", r.final_score, r.source_count, r.first_seen_at, r.last_seen_at,
                 [(a.article_id, a.similarity) for a in r.articles]) for r in rows if r.batch == n] for n in range(work.BATCHES)]
    events, came = slow(articles, batches, work.THRESHOLD, work.WINDOW)
    found = {r.event_id: (r.main_article_id, r.title, r.final_score, r.source_count, r.members) for r in QUERIES["stored_events"](spark, SF).collect()}
    assert found == {e["id"]: (e["main"], e["title"], e["score"], e["sources"], ",".join(map(str, e["members"]))) for e in events.values()}
    assert sum(len(r) for r, _ in came) > 20


def test_verified_clusters_query(spark):
    rows = [(r.article_id, r.ts, r.vec, r["keys"]) for r in work.reports_of(spark, SF).collect()]
    ids = {r[0] for r in rows}
    same = {(a, b) for a in ids for b in range(a + 1, a + 39) if b in ids and (a + b) % 5 > 0}
    groups = {}
    for r in QUERIES["verified_clusters"](spark, SF).collect():
        groups.setdefault(r.event_id, []).append(r.article_id)
    expected = slow_groups(rows, same, 0.9, 24)
    assert sorted(sorted(g) for g in groups.values()) == expected and sum(len(g) > 2 for g in expected) > 20


def test_merges_in_order_query(spark):
    e = F.col("event_id")
    sources = B.membership(spark, SF).groupBy("event_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    rows = B.clusters(spark, SF).join(sources, "event_id").select("event_id", "first_seen_at", "last_seen_at", "final_score", "sources", (e % 2 == 0).alias("lead")).collect()
    events = [(r.event_id, r.first_seen_at, r.last_seen_at, float(r.final_score), r.sources, r.lead, ["authority", "signal", "aggregator"][r.event_id % 3], f"T{r.event_id % 3 + 1}") for r in rows]
    cites = [(x[0], k) for x in events for k in (x[0] // 6, x[0] // 10 + 10**9)]
    expected = slow_merges(events, cites, dt.datetime(1994, 1, 1), 500 * 24)
    assert {r.source_id: r.target_id for r in QUERIES["merges_in_order"](spark, SF).collect()} == expected and expected
    assert event_store.redirects(spark.createDataFrame([("e", ["g"])], "event_id string, absorbed array<string>")).first().source_id == "g"
