"""Groups of new articles taken into the stored events, one batch at a time.

A group extends, in this order of preference, the event of its own id; the best
ranked event that has one of its articles; the best ranked event of the window
that cites a source it cites; the event of the window to whose members, all of
them, its main article is similar.  Else it is a new event.  Groups of a batch
come in order, and each meets what those before it have left.

Only groups and events that share an article or a source, or are similar enough,
can meet, directly or through others; such components are found by joins and
blocks of matrix products, and each is folded in order by one task, with the few
stored events it may touch.  What isn't touched is neither read as a whole nor
written: the result are the changed events alone.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.cluster import similar_pairs
from tidewire.operators.graph import bucketed, connected_labels
from tidewire.operators.recall import similar_members
from tidewire.operators.views import ROLE_RANK, TIER_RANK, ranked
from tidewire.session import checkpointed

MEMBER = "struct<article_id: bigint, similarity: double, priority: bigint, source_key: string, keys: array<string>, vec: array<double>, rank: array<int>>"
EVENT = ("event_id string, main_article_id bigint, title string, summary string, final_score double, source_count bigint, "
         "first_seen_at timestamp, last_seen_at timestamp, members array<" + MEMBER + ">")
#: Rows of whole components that are folded in one call.
BUCKET_ROWS = 20_000
EPOCH = pd.Timestamp(0)
_HEAD = ("event_id string, main_article_id bigint, title string, summary string, final_score double, source_count bigint, first_seen_at timestamp, "
         "last_seen_at timestamp, inserted boolean, absorbed array<string>")
_MEMBER = "article_id bigint, similarity double, priority bigint, source_key string, keys array<string>, vec array<double>, rank array<int>"
_FIELDS = [f.split()[0] for f in _MEMBER.split(", ")]


def article_facts(articles: DataFrame) -> DataFrame:
    """(article_id, published_at, source_key, keys, vec, rank) for groups and events.

    ``articles``: these with can_be_main, role and tier in place of ``rank``.
    """
    rank = F.array(F.coalesce(F.col("can_be_main").cast("int"), F.lit(0)), ranked(F.col("role"), ROLE_RANK), ranked(F.col("tier"), TIER_RANK))
    return articles.select("article_id", "published_at", "source_key", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"),
                           F.col("vec").cast("array<double>").alias("vec"), rank.alias("rank"))


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT)


def with_articles(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """``groups`` (group_id, ord, main_article_id, title, summary, final_score,
    source_count, first_seen_at, last_seen_at, articles: array of article_id and
    similarity) with what the fold needs of each article, in the given order."""
    each = groups.select("group_id", F.posexplode("articles").alias("at", "a")).select("group_id", "at", "a.article_id", "a.similarity")
    held = each.join(facts, "article_id").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(
        "at", "article_id", "similarity", "published_at", "source_key", "keys", "vec", "rank"))).alias("held"))
    return groups.drop("articles").join(held, "group_id")


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """(src, dst): each node with the least node of the same key."""
    hubs = rows.groupBy(key).agg(F.min("node").alias("src"))
    return rows.join(hubs, key).where("src <> node").select("src", F.col("node").alias("dst"))


def _components(groups: DataFrame, events: DataFrame, threshold: float, window_hours: float) -> DataFrame:
    """(node, label) of groups (``g:`` and id) and the events (``e:`` and id) they may touch."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    exploded = lambda df, kind, c, a: df.select(node(kind, c).alias("node"), F.explode(a).alias("m"))
    own = exploded(groups, "g:", "group_id", "held").select("node", F.col("m.article_id").alias("article"), "m.keys")
    stored = exploded(events, "e:", "event_id", "members").select("node", F.col("m.article_id").alias("article"), "m.keys")
    known = own.select("article").distinct()
    prior = stored.join(known, "article", "left_semi")
    same = events.select(node("e:", "event_id").alias("node"), F.col("event_id").alias("id")).join(groups.select(F.col("group_id").alias("id")), "id", "left_semi").select("node")
    oldest = groups.agg(F.min(F.unix_micros("last_seen_at"))).first()[0] or 0  # one number
    recent = events.where(F.unix_micros("last_seen_at") >= oldest - int(window_hours * 3600 * 10**6))
    live = checkpointed(recent.select(node("e:", "event_id").alias("node")).union(prior.select("node")).union(same).distinct())
    stored = stored.join(live, "node", "left_semi")
    by_key = lambda df: df.select("node", F.explode("keys").alias("key"))
    cited = by_key(stored).join(by_key(own).select("key").distinct(), "key", "left_semi").select("node", "key").union(by_key(own).select("node", "key"))
    links = _stars(cited.distinct(), "key").union(_stars(own.select("node", "article").union(prior.select("node", "article")), "article"))
    links = links.union(same.select(F.concat(F.lit("g:"), F.substring("node", 3, 1 << 30)), "node"))
    main = F.filter("held", lambda m: m.article_id == F.col("main_article_id"))
    with_vector = F.filter("held", lambda m: m.vec.isNotNull())
    vec = F.coalesce(F.get(main, 0)["vec"], F.get(with_vector, 0)["vec"])
    vectors = groups.select(node("g:", "group_id").alias("id"), vec.alias("vec"), F.col("last_seen_at").alias("ts")).where("vec is not null")
    near = similar_pairs(vectors, threshold=threshold, span_hours=window_hours).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    members = exploded(events.join(live, node("e:", "event_id") == F.col("node"), "left_semi"), "e:", "event_id", "members").select(
        F.col("node").alias("event_id"), F.col("m.article_id").alias("member_id"), "m.vec")
    spans = events.select(node("e:", "event_id").alias("event_id"), F.col("last_seen_at").alias("at"))
    similar = similar_members(vectors.select(F.col("id").alias("article_id"), "vec", F.col("ts").alias("at")), members.join(spans, "event_id"),
                              threshold=threshold, window_hours=window_hours).select(F.col("article_id").alias("src"), F.col("event_id").alias("dst"))
    links = links.union(near).union(similar).distinct()
    alone = groups.select(node("g:", "group_id").alias("node"))
    labels = connected_labels(links)
    return labels.union(alone.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))


class _Event:
    def __init__(self, event_id: str):
        self.event_id, self.inserted, self.absorbed, self.slot = event_id, False, [], None
        self.members: dict[int, dict] = {}
        self.keys, self.sources, self.vecs = set(), set(), []

    def facts(self, row) -> None:
        for name in ("main_article_id", "title", "summary", "final_score", "source_count", "first_seen_at", "last_seen_at"):
            setattr(self, name, getattr(row, name))

    def merge_rank(self) -> tuple:
        main = self.members.get(self.main_article_id)
        return (*(main["rank"] if main is not None else (0, 0, 0)), self.final_score or 0.0, self.source_count or 1, self.last_seen_at, self.event_id)

    def fits(self, row, window: pd.Timedelta) -> bool:
        joint = max(self.last_seen_at, row.last_seen_at) - min(self.first_seen_at, row.first_seen_at)
        return self.last_seen_at >= row.last_seen_at - window and joint <= window


class _Events:
    """The events of a component by id, by article and by when they were last
    seen, so a group meets those of its window and not all before it."""

    def __init__(self, window: pd.Timedelta):
        self.window, self.by_id, self.of_article, self.slots = window, {}, {}, {}

    def _slot(self, at: pd.Timestamp) -> int:
        return (at - EPOCH) // (self.window or pd.Timedelta(hours=1))

    def place(self, event: _Event) -> None:
        """Note when ``event`` was last seen."""
        slot = None if pd.isna(event.last_seen_at) else self._slot(event.last_seen_at)
        if slot != event.slot:
            self.slots.get(event.slot, {}).pop(event.event_id, None)
            event.slot = slot
        if slot is not None:
            self.slots.setdefault(slot, {})[event.event_id] = event

    def add(self, event: _Event, member: dict) -> None:
        event.members[member["article_id"]] = member
        event.keys.update(member["keys"])
        event.sources.add(member["source_key"])
        if member["vec"] is not None:
            event.vecs.append(member["vec"])
        self.of_article[member["article_id"]] = event.event_id

    def fitting(self, row) -> list[_Event]:
        """The events whose window ``row`` fits."""
        if pd.isna(row.last_seen_at):
            return []
        low = self._slot(row.last_seen_at - self.window)
        if pd.isna(row.first_seen_at):
            slots = [s for s in self.slots if s >= low]
        else:
            slots = range(low, self._slot(row.first_seen_at + self.window) + 1)
        return [e for s in slots for e in self.slots.get(s, {}).values() if e.fits(row, self.window)]


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / size if size else 0.0


def _similar(vec, fitting: list[_Event], threshold: float) -> str | None:
    if vec is None:
        return None
    best = None
    for e in fitting:
        if e.vecs:
            weakest = min(_cosine(vec, v) for v in e.vecs)
            if weakest >= threshold and (best is None or (-weakest, e.event_id) < best):
                best = (-weakest, e.event_id)
    return best[1] if best else None


def _take(row, held: dict[int, dict], events: _Events, threshold: float) -> _Event:
    """The event that a group extends or founds, changed accordingly."""
    prior = {a: events.of_article[a] for a in held if a in events.of_article}
    keys = {k for m in held.values() for k in m["keys"]}
    target = row.group_id if row.group_id in events.by_id else None
    if target is None and prior:
        target = max((events.by_id[e] for e in set(prior.values())), key=_Event.merge_rank).event_id
    if target is None:
        fitting = events.fitting(row)
        citing = [e for e in fitting if keys & e.keys]
        if citing:
            target = max(citing, key=_Event.merge_rank).event_id
        else:
            target = _similar(held[row.main_article_id]["vec"] if row.main_article_id in held else None, fitting, threshold)
    eligible = [m for a, m in held.items() if prior.get(a) in (None, target)]
    if target is None:
        event = events.by_id[row.group_id] = _Event(row.group_id)
        event.inserted = True
        event.facts(row)
    else:
        event = events.by_id[target]
        if len(eligible) == len(held) and (row.final_score or 0.0) > (event.final_score or 0.0):
            event.facts(row)
        elif eligible:
            event.last_seen_at = max(event.last_seen_at, *(m["published_at"] for m in eligible))
        if target != row.group_id:
            event.absorbed.append(row.group_id)
    events.place(event)
    main = event.members.get(event.main_article_id) or held.get(event.main_article_id)
    main_vec = main["vec"] if main else None
    for m in eligible:
        if m["article_id"] in event.members:
            continue
        similarity = m["similarity"]
        if event.event_id != row.group_id and m["vec"] is not None and main_vec is not None:
            similarity = _cosine(m["vec"], main_vec)
        events.add(event, {**m, "similarity": similarity, "priority": len(event.members)})
    event.source_count = len(event.sources)
    return event


def _folder(threshold: float, window_hours: float):
    window = pd.Timedelta(hours=window_hours)

    def fold(groups: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        events = _Events(window)
        for row in stored.sort_values("priority").itertuples():
            event = events.by_id.get(row.event_id)
            if event is None:
                event = events.by_id[row.event_id] = _Event(row.event_id)
                event.facts(row)
                events.place(event)
            events.add(event, {f: getattr(row, f) for f in _FIELDS})
        touched: dict[str, _Event] = {}
        ordered = groups.sort_values(["ord", "group_id", "at"], kind="stable").itertuples()
        for _, same in groupby(ordered, key=lambda r: (str(r.ord), r.group_id)):
            rows = list(same)
            held = {r.article_id: {"published_at": r.published_at, **{f: getattr(r, f, None) for f in _FIELDS}} for r in rows}
            event = _take(rows[0], held, events, threshold)
            touched[event.event_id] = event
        # what an event has absorbed goes with its first member only, as both grow
        rows = [(e.event_id, e.main_article_id, e.title, e.summary, e.final_score, e.source_count, e.first_seen_at, e.last_seen_at, e.inserted,
                 [] if i else e.absorbed, *(m[f] for f in _FIELDS)) for e in touched.values() for i, m in enumerate(e.members.values())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _HEAD.split(", ")] + _FIELDS, dtype=object)

    return fold


def upsert_groups(store: DataFrame, groups: DataFrame, facts: DataFrame, *, threshold: float = 0.85, window_hours: float = 72) -> DataFrame:
    """The events that a batch of groups changes or adds.

    ``store`` has the columns of ``EVENT``; ``inserted`` marks new events and
    ``absorbed`` lists the groups that went into an event of another id.
    """
    groups = checkpointed(with_articles(groups, facts))
    labels = checkpointed(_components(groups, store, threshold, window_hours))
    left = groups.withColumn("node", F.concat(F.lit("g:"), "group_id")).join(labels, "node").drop("node")
    own = labels.select("node", F.col("label").alias("label"))  # a column of its own: both sides use the labels
    right = store.withColumn("node", F.concat(F.lit("e:"), "event_id")).join(own, "node").drop("node").withColumn("label", F.col("label").alias("label"))
    left = left.select("*", F.explode("held").alias("m")).select(*left.columns, "m.*").drop("held")
    right = right.select("*", F.explode("members").alias("m")).select(*right.columns, "m.*").drop("members")
    rows = left.groupBy("label").cogroup(right.groupBy("label")).applyInPandas(_folder(threshold, window_hours), f"{_HEAD}, {_MEMBER}")
    head = [c.split()[0] for c in _HEAD.split(", ")][1:]
    member = F.struct("priority", F.struct(*_FIELDS).alias("m"))  # priorities of an event differ
    facts_of = [(F.flatten(F.collect_list(c)) if c == "absorbed" else F.first(c)).alias(c) for c in head]
    changes = rows.groupBy("event_id").agg(*facts_of, F.array_sort(F.collect_list(member)).alias("held"))
    return changes.select("event_id", *head[:7], F.transform("held", lambda x: x.m).alias("members"), "inserted", "absorbed")


def changed_store(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after a batch."""
    names = store.columns
    return store.join(changes.select("event_id"), "event_id", "left_anti").select(*names).unionByName(changes.select(*names))


def redirects(changes: DataFrame) -> DataFrame:
    """(source_id, target_id): groups that went into an event of another id."""
    return changes.select(F.explode("absorbed").alias("source_id"), F.col("event_id").alias("target_id"))


def membership(store: DataFrame) -> DataFrame:
    """(event_id, article_id, similarity, priority, is_main) of the stored events."""
    return store.select("event_id", "main_article_id", F.explode("members").alias("m")).select(
        "event_id", "m.article_id", "m.similarity", "m.priority", (F.col("m.article_id") == F.col("main_article_id")).alias("is_main"))


def merge_order(events: DataFrame, citations: DataFrame, *, since: Column, span_hours: float | None = None) -> DataFrame:
    """(source_id, target_id): events that fold into others for a shared source.

    Sources are taken in order; of the events that are left with one, the best
    ranked is the target and the others fold into it in order of their ids, as
    long as they last no longer than the span together.  A target grows: its
    span, its score and its sources are those of all it has taken, and decide
    what comes after.  An event that went before is followed to where it is.

    ``events``: event_id, first_seen_at, last_seen_at, final_score, sources
    (array) and can_be_main, role, tier of the main article; those seen last
    before ``since`` stay out.  ``citations``: event_id, key.  Events that no
    chain of shared sources links are folded apart; members are not needed.
    """
    rank = F.array(F.coalesce(F.col("can_be_main").cast("int"), F.lit(0)), ranked(F.col("role"), ROLE_RANK), ranked(F.col("tier"), TIER_RANK))
    live = events.where(F.col("last_seen_at") >= since).select("event_id", "first_seen_at", "last_seen_at", "final_score", "sources", rank.alias("rank"))
    cited = citations.select("event_id", "key").distinct().join(live.select("event_id"), "event_id", "left_semi")
    shared = cited.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    cited = checkpointed(cited.join(shared, "key", "left_semi"))
    labels = connected_labels(_stars(cited.select(F.col("event_id").alias("node"), "key"), "key").distinct())
    rows = cited.groupBy("event_id").agg(F.collect_list("key").alias("cites")).join(live, "event_id").join(labels, F.col("event_id") == labels.node).drop("node")
    kind = events.schema["event_id"].dataType.simpleString()
    dealt = bucketed(checkpointed(rows), "label", size=BUCKET_ROWS)  # components share neither sources nor events, so a fold takes many
    return dealt.groupBy("bucket").applyInPandas(_merger(span_hours), f"source_id {kind}, target_id {kind}")


def _merger(span_hours: float | None):
    span = None if span_hours is None else pd.Timedelta(hours=span_hours)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {r.event_id: {"lo": r.first_seen_at, "hi": r.last_seen_at, "score": r.final_score, "sources": set(r.sources), "rank": tuple(r.rank)}
                for r in pdf.itertuples()}
        events_of: dict[object, set] = {}
        for r in pdf.itertuples():
            for key in r.cites:
                events_of.setdefault(key, set()).add(r.event_id)
        gone: dict = {}

        def place(e):
            e = held[e]
            return (*e["rank"], e["score"] or 0.0, len(e["sources"]) or 1, e["hi"])

        def ends(e):
            while e in gone:
                e = gone[e]
            return e

        for key in sorted(events_of):
            left = {ends(e) for e in events_of[key]}
            if len(left) < 2:
                continue
            target = max(left, key=lambda e: (*place(e), e))
            into = held[target]
            for source in sorted(left - {target}):
                e = held[source]
                lo, hi = min(e["lo"], into["lo"]), max(e["hi"], into["hi"])
                if span is None or hi - lo <= span:
                    into |= {"lo": lo, "hi": hi, "score": max(e["score"] or 0.0, into["score"] or 0.0), "sources": into["sources"] | e["sources"]}
                    gone[source] = target
        return pd.DataFrame([(e, ends(e)) for e in gone], columns=["source_id", "target_id"])

    return fold


def folded_store(store: DataFrame, merges: DataFrame) -> DataFrame:
    """The store after ``merge_order``: members follow their events, each article
    once; the target's main, title and summary stay."""
    to = merges.select(F.col("source_id").alias("event_id"), "target_id")
    moving = store.join(to, "event_id", "left").withColumn("_own", F.col("target_id").isNull()).withColumn("event_id", F.coalesce("target_id", "event_id")).drop("target_id")
    touched = merges.select(F.col("target_id").alias("event_id")).distinct()
    calm = moving.join(touched, "event_id", "left_anti").select(*store.columns)
    own = lambda c: F.max_by(c, "_own").alias(c)
    merged = moving.join(touched, "event_id", "left_semi").groupBy("event_id").agg(
        own("main_article_id"), own("title"), own("summary"), F.max("final_score").alias("final_score"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("_own")).alias("o"), F.col("first_seen_at").alias("f"), F.col("main_article_id").alias("m"), "members"))),
                              lambda s: s.members)).alias("members"))
    once = F.filter("members", lambda m, i: F.array_position(F.transform("members", lambda x: x.article_id), m.article_id) == i + 1)
    merged = merged.withColumn("members", once)
    placed = F.transform("members", lambda m, i: m.withField("priority", i.cast("long")))
    merged = merged.withColumn("members", placed).withColumn("source_count", F.size(F.array_distinct(F.transform("members", lambda m: m.source_key))).cast("long"))
    return calm.unionByName(merged.select(*store.columns))

