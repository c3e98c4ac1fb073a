"""Sink, readers, and odd cases of event upkeep."""

import datetime as dt

import pytest

from tidewire.functions import articles as A
from tidewire.operators import events
from tidewire.operators.positions import with_positions
from tidewire.sources import feeds
from tidewire.streaming import intake


def batch(spark, *rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, d), e) for k, d, e in rows], "key string, ts timestamp, event_id long")


def test_sink_keeps_the_newest_row_and_survives_gaps(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = intake.upsert_sink(path, "key")
    write(batch(spark, ("a", 5, 1), ("b", 2, 2)), 0)
    write(batch(spark, ("a", 1, 3)), 1)
    write(batch(spark, ("c", 3, 4)), 3)
    write(batch(spark, ("c", 3, 4)), 3)
    got = {r.key: (r.ts.day, r.event_id) for r in intake.newest_version(spark, path).collect()}
    assert got == {"a": (5, 1), "b": (2, 2), "c": (3, 4)}


def test_sink_takes_batches_of_a_new_query(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = intake.upsert_sink(path, "key")
    context = spark.sparkContext
    for query, row in (("one", ("a", 1, 1)), ("two", ("b", 1, 2))):
        context.setLocalProperty("sql.streaming.queryId", query)
        write(batch(spark, row), 0)
    context.setLocalProperty("sql.streaming.queryId", None)
    assert sorted(r.key for r in intake.newest_version(spark, path).collect()) == ["a", "b"]


@pytest.mark.parametrize("kind", [*feeds.READERS, "unknown"])
def test_every_reader_takes_responses_and_settings(spark, kind):
    body = "<rss><channel></channel></rss>" if kind in ("rss", "telegram_rss", "unknown") else "<urlset></urlset>" if kind == "sitemap" else "[]"
    rows = spark.createDataFrame([("s", body), ("t", None)], "source_id string, body string")
    assert feeds.reader_for(kind)(rows, {}).count() == 0


def test_positions_are_the_order(spark):
    rows = spark.createDataFrame([(i * 7 % 101, None if i % 5 else i) for i in range(101)], "a long, b long")
    got = with_positions(rows, [rows.a.desc()], "place").collect()
    assert all(r.place == 101 - r.a for r in got)
    assert with_positions(rows.limit(0), [rows.a.asc()], "place").count() == 0


def test_reconcile_respects_span_since_and_rank(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 2, False, 9.0), (2, 2, 3, True, 1.0), (3, 9, 10, False, 5.0), (4, 1, 1, False, 7.0)]
    table = spark.createDataFrame([(e, day(a), day(b), m, "signal", "T1", s, 1) for e, a, b, m, s in rows],
                                  "event_id long, first_seen_at timestamp, last_seen_at timestamp, can_be_main boolean, role string, tier string, final_score double, source_count long")
    keys = spark.createDataFrame([(e, "k") for e in (1, 2, 3, 4)] + [(1, "k")], "event_id long, key string")
    got = {r.source_id: r.target_id for r in events.reconcile(table, keys, since=day(2), span_hours=72).collect()}
    assert got == {1: 2}
    assert {r.source_id for r in events.reconcile(table, keys, since=day(1)).collect()} == {1, 3, 4}


def test_deletion_cascades(spark):
    m = spark.createDataFrame([(1, 10, True, "a", 1), (1, 11, False, "b", 2), (2, 20, True, "a", 1)], "event_id long, article_id long, is_main boolean, source_id string, published_at long")
    clusters = spark.createDataFrame([(1, 10, 2, "x"), (2, 20, 1, "y")], "event_id long, main_article_id long, source_count long, label string")
    tables = {
        "membership": m, "clusters": clusters, "entries": m.select("article_id"),
        "submissions": spark.createDataFrame([(1, 10, "published", 5), (2, 11, "published", 6)], "id long, article_id long, publication_status string, published_at long"),
        "redirects": spark.createDataFrame([(7, 2), (8, 1)], "source_id long, target_id long"),
    }
    out = events.delete_articles(tables, m.where("article_id in (10, 20)").select("article_id"))
    assert [tuple(r) for r in out["clusters"].select("event_id", "main_article_id", "source_count", "label").collect()] == [(1, 11, 1, "x")]
    assert [r.article_id for r in out["entries"].collect()] == [11]
    assert sorted((r.id, r.article_id, r.publication_status, r.published_at) for r in out["submissions"].collect()) == [(1, None, "draft", None), (2, 11, "published", 6)]
    assert [r.source_id for r in out["redirects"].collect()] == [8]


def test_body_present(spark):
    rows = spark.createDataFrame([(["", None], 1), (["x"], 1), (None, 0)], "notes array<string>, n int")
    assert [r[0] for r in rows.select(A.body_present(rows.notes, rows.n)).collect()] == [False, True, True]


def test_blocked_pairs_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    from tidewire.operators import cluster

    rng = np.random.default_rng(3)
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 7)
    rows = [(i, rng.normal(size=4 if i % 9 else 3).tolist(), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 4000)))) for i in range(90)]
    rows += [(90, None, rows[0][2]), (91, [0.0] * 4, rows[0][2])]
    df = spark.createDataFrame(rows, "id long, vec array<double>, ts timestamp")

    def brute(span):
        out = set()
        for i, v, t in rows:
            for j, w, s in rows:
                if i < j and v and w and len(v) == len(w) and any(v) and any(w) and (span is None or abs((t - s).total_seconds()) <= span * 3600):
                    c = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                    if c >= 0.5:
                        out.add((i, j, round(c, 6)))
        return out

    for span in (None, 6, 24):
        got = [(r.a, r.b, round(r.similarity, 6)) for r in cluster.similar_pairs(df, threshold=0.5, span_hours=span).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(span)
