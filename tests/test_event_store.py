"""Batches taken into stored events against a loop over all of them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_gray_band import cosine
from tidewire.operators import event_store as store_of

START = dt.datetime(2024, 1, 1)
HOURS = dt.timedelta(hours=1)
ROLE, TIER = {"authority": 4, "official": 4, "signal": 3, "aggregator": 1}, {"T1": 3, "T2": 2, "T3": 1}
ARTICLES = "article_id long, published_at timestamp, source_key string, keys array<string>, vec array<double>, can_be_main boolean, role string, tier string"
GROUPS = ("group_id string, ord long, main_article_id long, title string, summary string, final_score double, source_count long, first_seen_at timestamp,"
          " last_seen_at timestamp, articles array<struct<article_id: long, similarity: double>>")


def fixture(seed, n_articles=120, n_groups=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(14, 4))
    articles = {}
    for a in range(n_articles):
        vec = None if a % 9 == 0 else (centres[rng.integers(14)] + rng.normal(scale=0.25, size=4)).tolist()
        articles[a] = (a, START + int(rng.integers(0, 200)) * HOURS, f"s{a % 7}", [f"k{rng.integers(25)}"] if a % 4 == 0 else None, vec,
                       bool(a % 3), ["authority", "signal", "aggregator"][a % 3], f"T{a % 3 + 1}")
    groups = []
    for g in range(n_groups):
        anchor = int(rng.integers(n_articles))
        near = sorted(a for a in articles if abs(articles[a][1] - articles[anchor][1]) <= 20 * HOURS)
        own = sorted({anchor, *rng.choice(near, size=min(len(near), int(rng.integers(0, 3)))).tolist()})
        times = [articles[a][1] for a in own]
        gid = f"g{g % 50:03d}" if g >= 50 else f"g{g:03d}"  # some ids come again
        groups.append((gid, g, anchor, f"t{g}", "s", float(rng.integers(0, 5)), len(own), min(times), max(times), [(a, 1.0 if a == anchor else 0.9) for a in own]))
    return articles, groups


def slow(articles, batches, threshold, window):
    events, came = {}, []
    window = window * HOURS

    def rank(e):
        main = articles[e["main"]] if e["main"] in e["members"] else None
        lead = (int(main[5]), ROLE.get(main[6], 0), TIER.get(main[7], 0)) if main else (0, 0, 0)
        return (*lead, e["score"], e["sources"], e["hi"], e["id"])

    for batch in batches:
        redirects, inserted = {}, set()
        for gid, _, main, title, _, score, _, lo, hi, own in sorted(batch, key=lambda g: g[1]):
            own = dict(own)
            fits = lambda e: e["hi"] >= hi - window and max(e["hi"], hi) - min(e["lo"], lo) <= window  # noqa: B023, E731
            holder = {a: e["id"] for e in events.values() for a in own if a in e["members"]}
            target = gid if gid in events else None
            if target is None and holder:
                target = max((events[e] for e in holder.values()), key=rank)["id"]
            if target is None:
                keys = {k for a in own for k in articles[a][3] or ()}
                citing = [e for e in events.values() if fits(e) and keys & {k for a in e["members"] for k in articles[a][3] or ()}]
                target = max(citing, key=rank)["id"] if citing else None
            if target is None and articles[main][4] is not None:
                alike = []
                for e in events.values():
                    held = [articles[a][4] for a in e["members"] if articles[a][4] is not None]
                    if held and fits(e) and min(cosine(articles[main][4], v) for v in held) >= threshold:
                        alike.append((-min(cosine(articles[main][4], v) for v in held), e["id"]))
                target = min(alike)[1] if alike else None
            may = [a for a in own if holder.get(a) in (None, target)]
            if target is None:
                inserted.add(gid)
                e = events[gid] = {"id": gid, "main": main, "title": title, "score": score, "lo": lo, "hi": hi, "members": {}}
            else:
                e = events[target]
                if len(may) == len(own) and score > e["score"]:
                    e |= {"main": main, "title": title, "score": score, "lo": lo, "hi": hi}
                elif may:
                    e["hi"] = max(e["hi"], *(articles[a][1] for a in may))
                if target != gid:
                    redirects[gid] = target
            for a in may:
                if a not in e["members"]:
                    likeness = own[a]
                    if e["id"] != gid and articles[a][4] is not None and articles[e["main"]][4] is not None and (e["main"] in e["members"] or e["main"] in own):
                        likeness = cosine(articles[a][4], articles[e["main"]][4])
                    e["members"][a] = round(likeness, 6)
            e["sources"] = len({articles[a][2] for a in e["members"]})
        came.append((redirects, inserted))
    return events, came


def view(rows):
    return {r.event_id: (r.main_article_id, r.title, r.final_score, r.source_count, r.first_seen_at, r.last_seen_at,
                         [(m.article_id, round(m.similarity, 6), m.priority) for m in r.members]) for r in rows}


def expected_view(events):
    return {e["id"]: (e["main"], e["title"], e["score"], e["sources"], e["lo"], e["hi"],
                      [(a, s, n) for n, (a, s) in enumerate(e["members"].items())]) for e in events.values()}


def frames(spark, articles):
    return store_of.article_facts(spark.createDataFrame(list(articles.values()), ARTICLES))


@pytest.mark.parametrize("seed", [2])
def test_three_batches_equal_the_loop(spark, seed):
    articles, groups = fixture(seed)
    batches = [groups[:25], groups[25:45], groups[45:]]
    events, came = slow(articles, batches, 0.9, 72)
    facts, store = frames(spark, articles), store_of.empty_store(spark)
    for batch, (redirects, inserted) in zip(batches, came, strict=True):
        changes = store_of.checkpointed(store_of.upsert_groups(store, spark.createDataFrame(batch, GROUPS).repartition(3), facts, threshold=0.9, window_hours=72))
        assert {r.source_id: r.target_id for r in store_of.redirects(changes).collect()} == redirects
        assert {r.event_id for r in changes.where("inserted").collect()} == inserted
        store = store_of.checkpointed(store_of.changed_store(store, changes))
    assert view(store.collect()) == expected_view(events)
    assert any(len(e["members"]) > 3 for e in events.values()) and any(r for r, _ in came[1:])
    mains = store_of.membership(store).where("is_main").groupBy("event_id").count().collect()
    assert all(r["count"] == 1 for r in mains)
    empty = spark.createDataFrame([], GROUPS)
    assert store_of.upsert_groups(store, empty, facts).collect() == []


def slow_merges(events, cites, since, span):
    held = {e[0]: {"lo": e[1], "hi": e[2], "score": e[3], "sources": set(e[4]), "rank": (int(e[5]), ROLE[e[6]], TIER[e[7]])} for e in events if e[2] >= since}
    gone = {}

    def ends(e):
        return ends(gone[e]) if e in gone else e

    for key in sorted({k for _, k in cites}):
        left = sorted({ends(e) for e, k in cites if k == key and e in held})
        if len(left) > 1:
            into = max(left, key=lambda e: (*held[e]["rank"], held[e]["score"], len(held[e]["sources"]), held[e]["hi"], e))
            for e in left:
                lo, hi = min(held[e]["lo"], held[into]["lo"]), max(held[e]["hi"], held[into]["hi"])
                if e != into and hi - lo <= span * HOURS:
                    held[into] |= {"lo": lo, "hi": hi, "score": max(held[e]["score"], held[into]["score"]), "sources": held[into]["sources"] | held[e]["sources"]}
                    gone[e] = into
    return {e: ends(e) for e in gone}


def test_merges_grow_and_are_refused_over_the_span(spark):
    at = lambda h: START + h * HOURS
    rows = [("a", at(0), at(20), 5.0, ["x"], True, "signal", "T1"), ("b", at(30), at(45), 4.0, ["y"], True, "signal", "T1"), ("c", at(40), at(60), 3.0, ["z"], True, "signal", "T1")]
    schema = "event_id string, first_seen_at timestamp, last_seen_at timestamp, final_score double, sources array<string>, can_be_main boolean, role string, tier string"
    cites = [("a", "k1"), ("b", "k1"), ("b", "k2"), ("c", "k2")]
    found = lambda span: {r.source_id: r.target_id for r in store_of.merge_order(
        spark.createDataFrame(rows, schema), spark.createDataFrame(cites, "event_id string, key string"), since=F.lit(START), span_hours=span).collect()}
    assert found(48) == {"b": "a"}  # a and b last 45 hours, so c no longer fits, though it fits b
    assert found(72) == {"b": "a", "c": "a"} and found(None) == found(72) and found(10) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_order_equals_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows, cites = [], []
    for e in range(80):
        lo = START + int(rng.integers(0, 150)) * HOURS
        rows.append((e, lo, lo + int(rng.integers(0, 20)) * HOURS, float(rng.integers(0, 4)), [f"s{x}" for x in rng.integers(0, 6, 2)], bool(rng.integers(2)),
                     ["authority", "signal", "aggregator"][e % 3], f"T{e % 3 + 1}"))
        cites += [(e, f"k{x}") for x in rng.integers(0, 40, 2)]
    schema = "event_id long, first_seen_at timestamp, last_seen_at timestamp, final_score double, sources array<string>, can_be_main boolean, role string, tier string"
    out = store_of.merge_order(spark.createDataFrame(rows, schema), spark.createDataFrame(cites, "event_id long, key string"), since=F.lit(START + 20 * HOURS), span_hours=48)
    expected = slow_merges(rows, cites, START + 20 * HOURS, 48)
    assert {r.source_id: r.target_id for r in out.collect()} == expected and len(expected) > 10


def test_folded_store_keeps_each_article_once(spark):
    member = lambda a, p: (a, 0.5, p, f"s{a % 2}", [], None, [0, 0, 0])
    rows = [("a", 1, "A", "", 1.0, 1, START, START + HOURS, [member(1, 0), member(2, 1)]), ("b", 3, "B", "", 9.0, 1, START - HOURS, START, [member(3, 0), member(2, 1)]),
            ("c", 5, "C", "", 2.0, 1, START, START, [member(5, 0)])]
    store = spark.createDataFrame(rows, store_of.EVENT)
    merges = spark.createDataFrame([("b", "a")], "source_id string, target_id string")
    found = {r.event_id: r for r in store_of.folded_store(store, merges).collect()}
    assert set(found) == {"a", "c"} and [(m.article_id, m.priority) for m in found["a"].members] == [(1, 0), (2, 1), (3, 2)]
    assert (found["a"].title, found["a"].final_score, found["a"].source_count, found["a"].first_seen_at) == ("A", 9.0, 2, START - HOURS)
