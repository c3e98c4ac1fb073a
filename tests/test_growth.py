"""Steps whose work once grew faster than their input."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.llm import components, hamming_search
from tidewire.operators import cluster, content, event_store, graph, rank, recall
from tidewire.plans import bindings, registry
from tidewire.sources import paged

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_key_that_many_events_cite_is_one_row_to_join(spark):
    articles = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "b"]), (3, ["z"]), (4, None)], "article_id long, keys array<string>")
    rows = [(i, [k], True, "signal", "T1", float(i % 7), 1, None) for i, k in enumerate("aabbbab")]
    events = spark.createDataFrame(rows, "event_id long, keys array<string>, can_be_main boolean, role string, tier string, final_score double, source_count int, last_seen_at timestamp")
    found = cluster.reference_matches(articles, events)
    assert {(r.article_id, r.event_id) for r in found.collect()} == {(1, 6), (2, 6)}
    below = optimized(found).split("Join", 1)[1]
    assert "Aggregate [key" in below


def test_probes_of_a_search_are_never_broadcast(spark):
    codes = spark.range(50).select(F.col("id").alias("code"))
    segments = hamming_search._segments(64, 8)
    index = codes.select("code", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), hamming_search._part(F.col("code"), a, w).alias("value"))
                                                     for s, (a, w) in enumerate(segments)])).alias("x")).select("code", "x.*")
    found = hamming_search._met(codes.select(F.col("code").alias("qcode"), F.lit(1).alias("bound")), index, segments, 0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.qcode, r.code) for r in found.collect()} == {(a, b) for a in range(50) for b in range(50) if bin(a ^ b).count("1") <= 1}


def test_feeds_of_any_length_are_read_whole_and_circles_end(spark, tmp_path):
    def capture(account, n, last=None):
        os.makedirs(folder := tmp_path / account / "all")
        for i in range(n):
            more = i + 1 < n or last is not None
            body = {"ok": True, "data": {"items": [{"title": str(i)}]}, "meta": {"has_more": more, "next_cursor": str(i + 1) if i + 1 < n else last}}
            (folder / f"{i}.json").write_text(json.dumps(body))

    capture("long", 1005)
    capture("circle", 3, last="1")
    paged.register(spark)
    feed = lambda account: spark.read.format("paged_feed").option("path", f"file://{tmp_path}").option("accounts", json.dumps([account])).load()
    assert feed("long").count() == 1005
    with pytest.raises(Exception, match="comes again"):
        feed("circle").collect()


def test_a_title_is_normalised_once_for_all_its_bigrams(spark):
    df = spark.createDataFrame([("Ab ab!c",), ("x",), (None,)], "t string").select(T.bigrams(F.lower("t")).alias("g"))
    assert [sorted(r.g) for r in df.collect()] == [["ab", "ba", "bc"], [], []]
    assert optimized(df.withColumn("h", F.size("g"))).split("array_distinct")[0].count("lambdafunction(if") <= 1
    both = spark.createDataFrame([("ab", "abc")], "a string, b string").select(T.bigram_affinity(T.bigrams(F.col("a")), T.bigrams(F.col("b"))).alias("x"))
    assert both.first().x == 0.5
    assert optimized(both).count("regexp_replace") == 2


def test_lines_are_read_once_and_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    m = bindings.membership(spark, SF)
    assert "Join" not in optimized(m) and "Join" not in optimized(bindings.clusters(spark, SF))
    rows = bindings.table(spark, SF, "lineitem").count()
    assert "RepartitionByExpression [l_orderkey" in optimized(m) and f", {-(-rows // 500)}" in optimized(m)


def test_the_list_of_hidden_rows_reads_the_view_once(spark):
    assert optimized(registry.QUERIES["admin_list"](spark, SF)).count("Join") <= optimized(registry.QUERIES["all_events_view"](spark, SF)).count("Join")


def test_items_of_a_model_stay_where_they_are(spark):
    items = spark.createDataFrame([(str(i), f"m{i % 3}", i, i) for i in range(30)], "event_id string, model_used string, final_score int, ord int")
    assert "strategy=broadcast" in optimized(rank.model_rank(items).where("model_rank = 1")) or "rightHint=(strategy=broadcast)" in rank.model_rank(items)._jdf.queryExecution().optimizedPlan().toString()


def test_articles_meet_events_in_parts(spark, monkeypatch):
    articles = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "article_id long, vec array<double>")
    events = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "event_id long, centroid array<double>")
    whole = sorted(map(tuple, recall.centroid_recall(articles, events, floor=0.5).collect()))
    monkeypatch.setattr(recall, "PART_ROWS", 3)
    monkeypatch.setattr(recall, "BLOCK_ROWS", 4)
    assert sorted(map(tuple, recall.centroid_recall(articles, events, floor=0.5).collect())) == whole and len(whole) > 20


def test_pages_come_to_a_worker_in_small_batches(spark):
    pages = spark.createDataFrame([(i, f"<p>page {i}</p>") for i in range(5)], "page_id long, html string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert sorted(r.body for r in content.extract_content(pages).collect()) == [f"page {i}" for i in range(5)]
    assert 0 < int(spark.conf.get(key)) <= content.BATCH_ROWS


def test_many_components_are_one_call(spark):
    rows = [(i, float(i), ["s"], True, "signal", "T1") for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, final_score double, sources array<string>, can_be_main boolean, role string, tier string").selectExpr(
        "*", "timestamp'2024-01-01' as first_seen_at", "timestamp'2024-01-01' as last_seen_at")
    cited = events.selectExpr("event_id", "event_id div 2 as key")
    merges = event_store.merge_order(events, cited, since=F.to_timestamp(F.lit("2023-01-01")))
    assert sorted(map(tuple, merges.collect())) == [(i, i + 1) for i in range(0, 12, 2)]
    assert "[bucket#" in optimized(merges)


def test_pairs_of_titles_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(registry, "PAIR_ROWS", 50)
    found = registry.QUERIES["sequence_affinity"](spark, SF)
    rows = bindings.table(spark, SF, "documents").count()
    assert f"Repartition {-(-rows // 50)}, true" in optimized(found)


@pytest.mark.parametrize("labels", [graph.connected_labels, components.connected_components])
def test_long_chains_settle_in_few_rounds(spark, labels):
    chain = [0, *range(90, 0, -1)]  # the least node is far from what the others settle on first
    edges = [*zip(chain, chain[1:]), (200, 201), (201, 200), (205, 201), (300, 300)]
    found = {r.node: r.label for r in labels(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()}
    found.pop(300, None)  # only a loop
    assert found == {**dict.fromkeys(chain, 0), 200: 200, 201: 200, 205: 200}
    assert labels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_what_an_event_absorbs_goes_with_one_member():
    day = pd.Timestamp("2024-01-01")
    member = {"similarity": 0.9, "published_at": day, "source_key": "s", "keys": [], "vec": None, "rank": [0, 0, 0]}
    rows = [{"group_id": f"g{g}", "ord": g, "at": at, "main_article_id": g, "title": "", "summary": "", "final_score": 1.0, "source_count": 1, "first_seen_at": day,
             "last_seen_at": day, "article_id": g + at, "priority": None, **member} for g in range(40) for at in (0, 1)]
    stored = pd.DataFrame(columns=["event_id", "priority"])
    out = event_store._folder(0.9, 72)(pd.DataFrame(rows), stored)
    assert len(out) == 41 and set(out.event_id) == {"g0"}
    assert sum(map(len, out.absorbed)) == 39 and out.absorbed.iloc[0] == [f"g{g}" for g in range(1, 40)]
