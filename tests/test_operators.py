import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.operators import cluster, graph, ledger, normalize, rank, upsert, views


def brute_dedupe(rows):
    seen, kept = set(), []
    for i, url, title, free in rows:
        keys = {("u", url)} | (set() if free else {("t", title)})
        if not keys & seen:
            seen |= keys
            kept.append(i)
    return kept


def test_two_key_dedupe_is_the_ordered_fold(spark):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(60)}", f"t{rng.randrange(60)}", rng.random() < 0.2) for i in range(150)]
    rows = [(1000, "u1", "t1", False), (1001, "u1", "t2", False), (1002, "u2", "t2", False)] + [(2000 + i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i long, u string, t string, free boolean").repartition(5)
    kept = normalize.dedupe_two_keys(df, url="u", title="t", order="i", exempt=F.col("free"))
    assert sorted(r.i for r in kept.collect()) == brute_dedupe(rows)


def brute_clusters(rows, threshold, span):
    groups = []
    for a, ts, vec, keys in sorted(rows, key=lambda r: (r[1], r[0])):
        best = None
        fits = [g for g in groups if max(max(m[1] for m in g), ts) - min(min(m[1] for m in g), ts) <= dt.timedelta(hours=span)]
        found = next((g for g in fits if set(keys) & {k for m in g for k in m[3]}), None)
        if found is None and vec is not None:
            for g in fits:
                own = [m[2] for m in g if m[2] is not None]
                if own:
                    worst = min(float(np.dot(vec, o) / np.linalg.norm(vec) / np.linalg.norm(o)) for o in own)
                    if worst >= threshold and (best is None or (worst, groups.index(g)) > best):
                        best = (worst, groups.index(g))
            found = groups[best[1]] if best else None
        if found is None:
            groups.append(found := [])
        found.append((a, ts, vec, keys))
    return sorted(sorted(m[0] for m in g) for g in groups)


def test_clusters_equal_the_greedy_rule(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(70):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=float(rng.uniform(0, 90)))
        vec = None if i % 9 == 0 else [float(x) for x in rng.normal([3, 0, 0] if i % 2 else [0, 3, 0], 1)]
        rows.append((i, ts, vec, [f"k{i % 13}"] if i % 6 == 0 else []))
    df = spark.createDataFrame(
        [(a, ts, a, v, k, True, "signal", "T1", 1.0, 10) for a, ts, v, k in rows],
        "article_id long, ts timestamp, ord long, vec array<double>, keys array<string>, can_be_main boolean, role string, tier string, final_score double, content_length int")
    out = cluster.cluster_articles(df.repartition(3), threshold=0.9, span_hours=24).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.event_id, []).append(r.article_id)
    assert sorted(sorted(g) for g in groups.values()) == brute_clusters(rows, 0.9, 24)


def test_redirects_stop_at_cycles_and_hops(spark):
    ids = spark.createDataFrame([("a",), ("x",), ("z",)], "id string")
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "source_id string, target_id string")
    found = {r.id: r.target for r in graph.follow_redirects(ids, table).collect()}
    assert found == {"a": "c", "x": "y", "z": "z"}


def test_health_average(spark):
    rows = [(1, dt.datetime(2024, 1, 1, h), h, ok) for h, ok in enumerate([True, False, True])]
    r = ledger.health_average(spark.createDataFrame(rows, "source_id long, ts timestamp, ord long, ok boolean")).first()
    assert (r.success_rate, r.error_count, r.observations) == (0.84, 0, 3)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    rules = {"k": F.coalesce("old.k", "new.k"), "v": upsert.keep_if_null("v")}
    once = upsert.upsert(old, new, "k", rules)
    twice = upsert.upsert(once, new, "k", rules)
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1), ("b", 2), ("c", 3)]


def items(spark, rows):
    return spark.createDataFrame(rows, "event_id string, model_used string, final_score long, source_count int, days_covered int, category string, ord long")


def test_model_rank_never_compares_scores_across_models(spark):
    df = items(spark, [("a", "A", 90, 1, 1, "x", 1), ("b", "A", 80, 1, 1, "x", 2), ("c", "B", 50, 1, 1, "x", 3)])
    assert [r.event_id for r in rank.model_rank(df).orderBy("position").collect()] == ["a", "b", "c"]


def test_weekly_floor_is_beyond_the_fill(spark):
    rows = [(f"m{i}", "A", 100 - i, 2, 1, "model", i) for i in range(48)] + [(f"s{i}", "A", 10 - i, 1, 1, "rare", 100 + i) for i in range(3)]
    assert rank.weekly_roster(items(spark, rows)).count() == 50


def test_monthly_fills_up_to_the_least(spark):
    rows = [(f"e{i}", "A", i, 2, 1, "x", i) for i in range(3)] + [(f"s{i}", "A", i, 1, 1, "x", 50 + i) for i in range(20)]
    assert rank.monthly_roster(items(spark, rows)).count() == 10


def test_hotspot_tiers(spark):
    df = spark.createDataFrame([(1, 9, 1, 1, 1), (2, 2, 2, 1, 1)], "event_id long, window_report_count long, window_source_count long, final_score long, last_seen_at long")
    assert [r.event_id for r in views.hotspot_board(df).collect()] == [2, 1]


def test_text_pieces(spark):
    df = spark.createDataFrame([("一二三四五。六七八九十" * 3,), (None,), ("",)], "body string")
    pieces = [r.piece for r in normalize.split_long_paragraph(df, body="body", limit=12).collect()]
    assert "".join(pieces) == "一二三四五。六七八九十" * 3 and max(map(len, pieces)) <= 12


def test_merge_keeps_one_row_for_an_article(spark):
    m = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("b", 2, False)], "event_id string, article_id long, is_main boolean")
    merges = spark.createDataFrame([("b", "a")], "source_id string, target_id string")
    out = cluster.merge_events(m, merges)
    assert out.select("event_id", "article_id").distinct().count() == out.count() == 2


def test_centroid_recall_takes_every_member(spark, tmp_path):
    from tidewire.plans.registry import QUERIES

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(7, 16))
    rows = [(i, (centres[i // 30 % 7] + rng.normal(size=16)).tolist(), i // 30 % 7) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["centroid_recall"](spark, str(tmp_path)).collect())
    vectors, labels = np.array([v for _, v, _ in rows]), np.array([e for _, _, e in rows])
    means = np.stack([vectors[labels == e].mean(0) for e in range(7)])
    cosines = vectors @ means.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(means, axis=1)
    expected = []
    for i, row in enumerate(cosines):
        near = sorted((-c, e) for e, c in enumerate(row) if c >= 0.2)[:2]
        expected += [(i, e, n + 1) for n, (_, e) in enumerate(near)]
    assert got == sorted(expected) and {e for _, e, _ in got} == set(range(7))
