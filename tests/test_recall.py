"""Stored events for new articles, against a loop over all of them."""

import datetime as dt

import numpy as np
import pytest

from tests.test_gray_band import cosine
from tidewire.operators import recall

START = dt.datetime(2024, 1, 1)


def fixture(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 3))
    vec = lambda: (centres[rng.integers(6)] + rng.normal(scale=0.3, size=3)).tolist()
    events, members = [], []
    for e in range(30):
        first = START + dt.timedelta(hours=int(rng.integers(0, 120)))
        events.append((2**60 + e, first, first + dt.timedelta(hours=int(rng.integers(0, 40)))))
        base = centres[rng.integers(6)]
        for m in range(int(rng.integers(1, 5))):
            own = None if (e + m) % 13 == 5 else [1.0, 2.0] if (e + m) % 17 == 3 else (base + rng.normal(scale=0.3, size=3)).tolist()
            members.append((2**60 + e, 1000 * e + m, own))
    articles = []
    for a in range(40):
        first = START + dt.timedelta(hours=int(rng.integers(0, 160)))
        articles.append((-a, None if a % 11 == 4 else vec(), first, first + dt.timedelta(hours=a % 4)))
    same = {(a[0], m[1]) for a in articles for m in members if rng.random() < 0.5}
    return articles, events, members, same


def slow(articles, events, members, threshold, window, same=None):
    out = {}
    spans = {e: (lo, hi) for e, lo, hi in events}
    window = dt.timedelta(hours=window)
    for a, vec, lo, hi in articles:
        if vec is None:
            continue
        fits = {e: s[1] >= hi - window and max(s[1], hi) - min(s[0], lo) <= window for e, s in spans.items()}
        weakest, band = {}, []
        for e in spans:
            held = [v for x, _, v in sorted(members) if x == e and v is not None]
            if not held:
                continue
            weakest[e] = min(cosine(vec, v) for v in held)
            center = np.mean([v for v in held if len(v) == len(held[0])], axis=0)
            if weakest[e] < threshold and cosine(vec, list(center)) >= 0.80:
                band.append((-round(cosine(vec, list(center)), 9), e))
        match = None
        for w, e in sorted((-round(w, 9), e) for e, w in weakest.items() if w >= threshold):
            if fits[e] and (same is None or all((a, m) in same for x, m, _ in members if x == e)):
                match = (e, False)
                break
        if match is None and same is not None:
            for _, e in sorted(band)[:2]:
                near = max(((cosine(vec, v), -m) for x, m, v in members if x == e and v is not None))
                if fits[e] and (a, -near[1]) in same:
                    match = (e, True)
                    break
        if match:
            out[a] = match
    return out


@pytest.mark.parametrize("asks", [False, True])
def test_recall_equals_a_loop(spark, monkeypatch, asks):
    monkeypatch.setattr(recall, "BLOCK_ROWS", 7)
    articles, events, members, same = fixture(5)
    df = spark.createDataFrame(articles, "article_id long, vec array<double>, first_seen_at timestamp, last_seen_at timestamp")
    store = spark.createDataFrame(events, "event_id long, first_seen_at timestamp, last_seen_at timestamp")
    held = spark.createDataFrame(members, "event_id long, member_id long, vec array<double>")
    verdicts = spark.createDataFrame([(m, a, True) for a, m in same], "low_id long, high_id long, same boolean") if asks else None
    out = recall.nearest_events(df, store, held, threshold=0.93, window_hours=72, verdicts=verdicts).collect()
    expected = slow(articles, events, members, 0.93, 72, same if asks else None)
    assert {r.article_id: (r.event_id, r.gray) for r in out} == expected and len(out) == len(expected) > 5
    assert not asks or {gray for _, gray in expected.values()} == {False, True}


def test_old_members_count_and_spans_bind(spark):
    """One equal member of today doesn't outweigh an opposite one of last week."""
    day = dt.timedelta(days=1)
    df = spark.createDataFrame([(1, [1.0, 0.0], START, START)], "article_id long, vec array<double>, first_seen_at timestamp, last_seen_at timestamp")
    held = spark.createDataFrame([("a", 10, [1.0, 0.0]), ("a", 11, [-1.0, 0.0]), ("b", 12, [1.0, 0.1])], "event_id string, member_id long, vec array<double>")
    found = lambda first: recall.nearest_events(
        df, spark.createDataFrame([("a", START - 5 * day, START), ("b", first, START)], "event_id string, first_seen_at timestamp, last_seen_at timestamp"),
        held, threshold=0.9, window_hours=144).collect()
    assert [r.event_id for r in found(START - day)] == ["b"]
    assert found(START - 7 * day) == []


def test_centroids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    events, articles = rng.normal(size=(20, 4)), rng.normal(size=(30, 4))
    out = recall.centroid_recall(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(articles)], "article_id long, vec array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(events)], "event_id long, centroid array<double>"), floor=0.3, k=2).collect()
    expected = set()
    for i, v in enumerate(articles):
        near = sorted(((-cosine(v, c), e) for e, c in enumerate(events) if cosine(v, c) >= 0.3))[:2]
        expected |= {(i, e, n + 1) for n, (_, e) in enumerate(near)}
    assert {(r.article_id, r.event_id, r.place) for r in out} == expected
