"""Grouping with outside verdicts against the rule read row by row."""

import datetime as dt

import numpy as np
import pytest

from tidewire.operators import cluster, greedy

COLUMNS = ("article_id long, ts timestamp, ord long, vec array<double>, keys array<string>, can_be_main boolean, role string, tier string,"
           " final_score double, content_length int")


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not np.linalg.norm(a) or not np.linalg.norm(b):
        return 0.0
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def slow(rows, same, threshold, span, floor=0.80):
    """Events in order of their first article; all of them in one loop."""
    events = []
    ask = lambda a, b: (min(a, b), max(a, b)) in same
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        article, ts, vec, keys = row
        open_ = [e for e in events if (ts - e[0][1]).total_seconds() <= span * 3600]
        at = next((e for e in open_ if set(keys or ()) & {k for m in e for k in m[3] or ()}), None)
        if at is None and vec is not None:
            direct, gray = [], []
            for n, e in enumerate(events):
                held = [m[2] for m in e if m[2] is not None]
                if e not in open_ or not held:
                    continue
                weakest = min(cosine(vec, h) for h in held)
                if weakest >= threshold:
                    direct.append((weakest, n))
                else:
                    usable = [h for h in held if len(h) == len(held[0])]
                    recall = cosine(vec, list(np.mean(usable, axis=0)))
                    if recall >= floor:
                        gray.append((recall, n))
            for _, n in sorted(direct, reverse=True):
                if all(ask(article, m[0]) for m in events[n]):
                    at = events[n]
                    break
            if at is None:
                for _, n in sorted(gray, reverse=True)[:2]:
                    closest = max(events[n], key=lambda m: cosine(vec, m[2]))
                    if ask(article, closest[0]):
                        at = events[n]
                        break
        if at is None:
            events.append(at := [])
        at.append(row)
    return sorted(sorted(m[0] for m in e) for e in events)


def fixture(n, seed, width=3, hours=60.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, hours * 60)))
        vec = None if i % 17 == 0 else (centres[rng.integers(5)] + rng.normal(scale=0.35, size=width)).tolist()
        vec = [1.0, 0.5] if i % 23 == 1 else vec
        rows.append((i, ts, vec, [f"k{i % 11}"] if i % 8 == 0 else [] if i % 2 else None))
    same = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25}
    return rows, same


def frames(spark, rows, same):
    df = spark.createDataFrame([(a, ts, a, v, k, True, "signal", "T1", 1.0, 10) for a, ts, v, k in rows], COLUMNS)
    verdicts = [(b, a, True) if (a + b) % 2 else (a, b, True) for a, b in same] + [(1, 2, None), (5, 5, True)]
    return df, spark.createDataFrame(verdicts + verdicts[:3], "low_id long, high_id long, same boolean")


def events_of(out):
    groups = {}
    for r in out.collect():
        groups.setdefault(r.event_id, []).append(r.article_id)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_gray_band_equals_the_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(greedy, "BLOCK_ROWS", 15)  # several blocks for each band
    rows, same = fixture(90, seed)
    df, verdicts = frames(spark, rows, same)
    out = cluster.cluster_articles(df.repartition(3), threshold=0.95, span_hours=24, verdicts=verdicts)
    expected = slow(rows, same, 0.95, 24)
    assert events_of(out) == expected
    assert any(len(e) > 1 for e in expected) and expected != slow(rows, set(), 0.95, 24)


def test_two_rivals_take_the_places(spark):
    """Two closer events of others fill both places, so the third is not asked."""
    day = dt.datetime(2024, 1, 1)
    at = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(0, day, at(0.5), []), (1, day + dt.timedelta(hours=1), at(0.3), []), (2, day + dt.timedelta(hours=2), at(-0.3), []), (3, day + dt.timedelta(hours=3), at(0.0), [])]
    df, verdicts = frames(spark, rows, {(0, 3)})
    assert events_of(cluster.cluster_articles(df, threshold=0.99, span_hours=24, verdicts=verdicts)) == [[0], [1], [2], [3]]
    df, verdicts = frames(spark, [r for r in rows if r[0] != 2], {(0, 3)})
    assert events_of(cluster.cluster_articles(df, threshold=0.99, span_hours=24, verdicts=verdicts)) == [[0, 3], [1]]
    late = [(a, ts + dt.timedelta(hours=100 * (a == 3)), v, k) for a, ts, v, k in rows]
    df, verdicts = frames(spark, late, {(0, 3)})
    assert events_of(cluster.cluster_articles(df, threshold=0.99, span_hours=24, verdicts=verdicts)) == [[0], [1], [2], [3]]


def test_no_verdict_joins_nothing_by_similarity(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day, [1.0, 0.0], ["k"] if i > 1 else []) for i in range(4)]
    df, verdicts = frames(spark, rows, set())
    assert events_of(cluster.cluster_articles(df, threshold=0.9, verdicts=verdicts)) == [[0], [1], [2, 3]]
    assert cluster.cluster_articles(df.where("false"), threshold=0.9, verdicts=verdicts).collect() == []


def test_pauses_cut_components(spark):
    rows, _ = fixture(60, 4, hours=400.0)
    df, _ = frames(spark, [(a, ts, v, ["same"]) for a, ts, v, _ in rows], set())
    found = greedy._sessions(df.withColumn("label", df.article_id * 0), 24).select("ts", "session").collect()
    times = sorted((r.ts, r.session) for r in found)
    for (a, s), (b, t) in zip(times, times[1:]):
        assert (s == t) or (b - a).total_seconds() > 24 * 3600
    assert len({s for _, s in times}) > 1
