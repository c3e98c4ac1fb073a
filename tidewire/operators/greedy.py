"""Greedy grouping of articles in order of publication, with a gray band.

An article joins, in this order of preference,

1. the oldest event that cites a source it cites too;
2. the event whose least similar member is most similar to it, at the threshold
   or above; where verdicts are given, all its members need one for the article;
3. where verdicts are given, one of the two events with the most similar
   centroids between the floor and the threshold, if the member most similar to
   the article has a verdict for it.

All of it within a span of hours from the event's first article.  Without any of
these the article founds an event.

Only articles of one component of shared keys, and of links that rule 2 or 3
needs, can meet in an event, so components are folded apart, and where a
component pauses for longer than the span it is cut.  Rule 3 alone looks beyond:
events of other components may take its two places.  They are found as blocks of
matrix products between the articles with a verdict and the events that were
open then; the fold is repeated with them until nothing changes.  A state that
is its own successor is the greedy one, since each decision in it follows from
the decisions before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.graph import bucketed, connected_labels
from tidewire.session import checkpointed

GRAY_FLOOR = 0.80
GRAY_PLACES = 2
BLOCK_ROWS = 2000
MOST_ROUNDS = 50
#: Rows of whole components that are folded in one call.
BUCKET_ROWS = 2000
RIVALS = "array<struct<recall: double, at: long, ord: long>>"


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw, unit, widths) of vectors, padded with zeros; width -1 for none."""
    widths = np.array([-1 if v is None else len(v) for v in vectors])
    raw = np.zeros((len(vectors), max(1, widths.max(initial=1))))
    for i, v in enumerate(vectors):
        if v is not None:
            raw[i, : len(v)] = v
    size = np.linalg.norm(raw, axis=1, keepdims=True)
    return raw, raw / np.where(size > 0, size, 1), widths


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def founders(pdf: pd.DataFrame, threshold: float, span_hours: float | None, verdicts: bool) -> np.ndarray:
    """For rows in order of publication the row that founded their event."""
    n = len(pdf)
    ids, keys = pdf.article_id.tolist(), pdf["keys"].tolist()
    raw, unit, widths = unit_rows(pdf.vec.tolist())
    at = _micros(pdf.ts)
    order = list(zip(at.tolist(), pdf.ord.tolist(), strict=True))
    span = None if span_hours is None else int(span_hours * 3600 * 10**6)
    founder = np.full(n, -1)
    sums, first_width = np.zeros_like(raw), np.full(n, -1)
    cited: dict[object, set[int]] = {}  # a source's events, by the row of their founder
    for i in range(n):
        since = 0 if span is None else int(np.searchsorted(at[:i], at[i] - span))
        own = set(keys[i]) if keys[i] is not None else set()
        meets = [g for key in own for g in cited.get(key, ()) if g >= since]
        choice = min(meets, default=None)
        if choice is None and widths[i] >= 0 and i > since:
            choice = _similar(i, since, ids, order, unit, widths, founder, sums, first_width, threshold, verdicts, pdf)
        founder[i] = i if choice is None else choice
        group = founder[i]
        for key in own:
            cited.setdefault(key, set()).add(group)
        if widths[i] >= 0:
            if first_width[group] < 0:
                first_width[group] = widths[i]
            if first_width[group] == widths[i]:
                sums[group] += raw[i]
    return founder


def _similar(i, since, ids, order, unit, widths, founder, sums, first_width, threshold, verdicts, pdf) -> int | None:
    """The event that rules 2 and 3 give for row ``i``."""
    rows = np.flatnonzero((founder[since:i] >= since) & (widths[since:i] >= 0)) + since
    if not len(rows):
        return None
    score = np.where(widths[rows] == widths[i], unit[rows] @ unit[i], 0.0)
    groups, code = np.unique(founder[rows], return_inverse=True)
    weakest = np.full(len(groups), np.inf)
    np.minimum.at(weakest, code, score)
    friends = set(pdf.friends.iat[i]) if verdicts and pdf.friends.iat[i] is not None else set()
    direct = sorted(((w, g) for w, g in zip(weakest.tolist(), groups.tolist(), strict=True) if w >= threshold), reverse=True)
    for _, g in direct:
        if not verdicts or all(ids[j] in friends for j in np.flatnonzero(founder[since:i] == g) + since):
            return g
    if not verdicts or not friends:
        return None
    length = np.linalg.norm(sums[groups], axis=1)
    recall = np.where(first_width[groups] == widths[i], sums[groups] @ unit[i] / np.where(length > 0, length, 1), 0.0)
    band = [(r, order[g], g) for r, w, g in zip(recall.tolist(), weakest.tolist(), groups.tolist(), strict=True) if w < threshold and r >= GRAY_FLOOR]
    rivals = pdf.rivals.iat[i]
    band += [(r["recall"], (r["at"], r["ord"]), -1) for r in ([] if rivals is None else rivals)]
    for _, _, g in sorted(band, reverse=True)[:GRAY_PLACES]:
        if g < 0:
            continue
        members = np.flatnonzero(founder[since:i] == g) + since
        near = np.where(widths[members] == widths[i], unit[members] @ unit[i], 0.0)
        if ids[members[int(near.argmax())]] in friends:
            return g
    return None


def _sessions(rows: DataFrame, span_hours: float | None) -> DataFrame:
    """``rows`` with ``session``: parts of a component that a pause of more than
    the span divides.  Pauses are looked for between time bands, of which a
    component has few, not between rows."""
    if span_hours is None:
        return rows.withColumn("session", F.lit(0).cast("long"))
    micros = int(span_hours * 3600 * 10**6)
    rows = rows.withColumn("band", F.floor(F.unix_micros("ts") / F.lit(micros)))
    bands = rows.groupBy("label", "band").agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    along = Window.partitionBy("label").orderBy("band")
    cut = (F.col("lo") - F.lag("hi").over(along) > micros).cast("long")
    bands = bands.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("session", F.sum("cut").over(along))
    return rows.join(bands.select("label", "band", "session"), ["label", "band"]).drop("band")


def _folded(linked: DataFrame, threshold: float, span_hours: float | None, verdicts: bool) -> DataFrame:
    """(article_id, founder_id, founder_ts, founder_ord) of rows with a component."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "session", "ts", "ord"], kind="stable").reset_index(drop=True)
        part = list(zip(pdf.label.tolist(), pdf.session.tolist(), strict=True))
        starts = [i for i in range(len(part)) if i == 0 or part[i] != part[i - 1]]
        at = np.concatenate([founders(pdf.iloc[a:b], threshold, span_hours, verdicts) + a for a, b in zip(starts, [*starts[1:], len(part)], strict=True)])
        return pd.DataFrame({"article_id": pdf.article_id, "founder_id": pdf.article_id.to_numpy()[at],
                             "founder_ts": pdf.ts.to_numpy()[at], "founder_ord": pdf.ord.to_numpy()[at]})

    kind = linked.schema["article_id"].dataType.simpleString()
    return bucketed(linked, "label", "session", size=BUCKET_ROWS).groupBy("bucket").applyInPandas(fold, f"article_id {kind}, founder_id {kind}, founder_ts timestamp, founder_ord long")


def _rivals(waiting: DataFrame, members: DataFrame, threshold: float, span_hours: float | None) -> DataFrame:
    """(article_id, rivals): the best events of other components in the band.

    ``waiting``: article_id, label, vec, ts, ord; ``members``: the same with
    founder_id, founder_ts, founder_ord.  An event's members are dealt to one
    block of its founder's time band, the waiting articles to all blocks of their
    own band and the one before; a block gives its best ``GRAY_PLACES`` only.
    """
    seconds = None if span_hours is None else span_hours * 3600
    band = lambda c: F.lit(0).cast("long") if seconds is None else F.floor(F.unix_micros(c) / F.lit(int(seconds * 10**6)))
    members = members.withColumn("band", band("founder_ts"))
    blocks = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    right = members.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("founder_id"), F.col("blocks")).cast("int"))
    left = waiting.withColumn("band", F.explode(F.array(band("ts")) if seconds is None else F.array(band("ts"), band("ts") - 1)))
    left = left.join(blocks, "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["band", "block", "article_id", "label", "vec", "ts", "ord"]
    dealt = left.select(*[F.col(n).alias(n) for n in names]).groupBy("band", "block").cogroup(
        right.select(*names, "founder_id", "founder_ts", "founder_ord").groupBy("band", "block"))
    kind = waiting.schema["article_id"].dataType.simpleString()
    best = dealt.applyInPandas(_block_rivals(threshold, seconds), f"article_id {kind}, recall double, at long, ord long")
    return best.groupBy("article_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("recall", "at", "ord")), asc=False), 1, GRAY_PLACES).alias("rivals"))


def _block_rivals(threshold: float, seconds: float | None):
    def rivals(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["founder_ts", "founder_ord", "founder_id", "ts", "ord"], kind="stable").reset_index(drop=True)
        out: dict[str, list] = {"article_id": [], "recall": [], "at": [], "ord": []}
        if not len(left) or not len(right):
            return pd.DataFrame(out, dtype=object)
        raw, unit, widths = unit_rows(right.vec.tolist())
        _, wanted, own_widths = unit_rows(left.vec.tolist())
        starts = np.flatnonzero(np.concatenate(([True], right.founder_id.to_numpy()[1:] != right.founder_id.to_numpy()[:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(right)]))
        usable = widths == widths[starts][group]  # a centroid has the width of the event's first vector
        sums = np.cumsum(np.where(usable[:, None], raw, 0), axis=0)
        sums -= np.concatenate((np.zeros((1, raw.shape[1])), sums))[starts][group]
        length = np.linalg.norm(sums, axis=1)
        moments = [list(zip(_micros(side.ts).tolist(), side.ord.tolist(), strict=True)) for side in (right, left)]
        rank = {m: r for r, m in enumerate(sorted({*moments[0], *moments[1]}))}
        before, when = (np.array([rank[m] for m in own]) for own in moments)
        now, begun, labels = _micros(left.ts), _micros(right.founder_ts)[starts], right.label.to_numpy()[starts]
        width = max(raw.shape[1], wanted.shape[1])
        raw, unit, wanted = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (np.where(usable[:, None], raw, 0), unit, wanted))
        for first in range(0, len(left), 256):
            rows = slice(first, first + 256)
            seen = before[None, :] < when[rows, None]
            count = np.add.reduceat(seen.astype(np.int64), starts, axis=1)
            near = np.where(widths[None, :] == own_widths[rows, None], wanted[rows] @ unit.T, 0.0)
            weakest = np.minimum.reduceat(np.where(seen, near, np.inf), starts, axis=1)
            dots = np.add.reduceat(np.where(seen, wanted[rows] @ raw.T, 0.0), starts, axis=1)
            size = length[np.maximum(starts[None, :] + count - 1, 0)]
            recall = np.where((size > 0) & (widths[starts][None, :] == own_widths[rows, None]), dots / np.where(size > 0, size, 1), 0.0)
            keep = (count > 0) & (weakest < threshold) & (recall >= GRAY_FLOOR) & (labels[None, :] != left.label.to_numpy()[rows, None])
            if seconds is not None:
                keep &= now[rows, None] - begun[None, :] <= int(seconds * 10**6)
            for i in np.flatnonzero(keep.any(1)).tolist():
                held = np.flatnonzero(keep[i])
                for g in held[np.lexsort((held, recall[i, held]))[::-1][:GRAY_PLACES]].tolist():
                    out["article_id"].append(left.article_id.iat[first + i])
                    out["recall"].append(float(recall[i, g]))
                    out["at"].append(int(begun[g]))
                    out["ord"].append(int(right.founder_ord.iat[starts[g]]))
        return pd.DataFrame(out, dtype=object)

    return rivals


def same_pairs(verdicts: DataFrame) -> DataFrame:
    """(article_id, friend): both directions of the pairs found to be one event.

    ``verdicts``: low_id, high_id, same; a pair in any order counts, and one with
    differing rows is not the same.
    """
    low, high = F.least("low_id", "high_id"), F.greatest("low_id", "high_id")
    same = verdicts.groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.coalesce("same", F.lit(False))).alias("same")).where("same and a <> b")
    side = lambda x, y: F.struct(F.col(x).alias("article_id"), F.col(y).alias("friend"))
    return same.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")


def verdict_pairs(articles: DataFrame, verdicts: DataFrame, span_hours: float | None) -> DataFrame:
    """The same of ``articles`` that lie within the span of one another."""
    times = articles.select("article_id", F.unix_micros("ts").alias("at"))
    near = same_pairs(verdicts).join(times, "article_id").join(times.select(F.col("article_id").alias("friend"), F.col("at").alias("other")), "friend")
    if span_hours is not None:
        near = near.where(F.abs(F.col("at") - F.col("other")) <= int(span_hours * 3600 * 10**6))
    return near.select("article_id", "friend")


def grouped(articles: DataFrame, links: DataFrame, *, threshold: float, span_hours: float | None, verdicts: DataFrame | None = None) -> DataFrame:
    """(article_id, founder_id) by the rules above.

    ``articles``: article_id, ts, ord, vec, keys; ``links``: (src, dst) of
    articles that may join one event by keys, or by similarity alone.
    """
    articles = articles.select("article_id", "ts", F.col("ord").cast("long").alias("ord"), "vec", "keys")
    friends = None
    if verdicts is not None:
        friends = checkpointed(verdict_pairs(articles, verdicts, span_hours))
        links = links.union(friends.select(F.col("article_id"), F.col("friend")))
    labels = connected_labels(links.distinct())
    rows = articles.join(labels.withColumnRenamed("node", "article_id"), "article_id", "left")
    linked = _sessions(rows.where("label is not null"), span_hours)
    alone = rows.where("label is null").select("article_id", F.col("article_id").alias("founder_id"), F.col("ts").alias("founder_ts"), F.col("ord").alias("founder_ord"))
    none = F.lit(None)
    if friends is None:
        linked = checkpointed(linked).withColumn("friends", none.cast("array<string>")).withColumn("rivals", none.cast(RIVALS))
        return _folded(linked, threshold, span_hours, False).unionByName(alone).select("article_id", "founder_id")
    linked = checkpointed(linked.join(friends.groupBy("article_id").agg(F.collect_list("friend").alias("friends")), "article_id", "left"))
    found = checkpointed(_folded(linked.withColumn("rivals", none.cast(RIVALS)), threshold, span_hours, True))
    waiting = linked.where("friends is not null and vec is not null").select("article_id", "label", "vec", "ts", "ord")
    vectors = rows.where("vec is not null").select("article_id", "vec", "ts", "ord", "label")
    for _ in range(MOST_ROUNDS):
        held = vectors.join(found.unionByName(alone), "article_id").withColumn("label", F.coalesce("label", F.col("founder_id")))
        rivals = checkpointed(_rivals(waiting, held, threshold, span_hours))
        after = checkpointed(_folded(linked.join(rivals, "article_id", "left"), threshold, span_hours, True))
        moved = after.join(found.select("article_id", F.col("founder_id").alias("was")), "article_id").where("founder_id <> was")
        found = after
        if moved.isEmpty():
            return found.unionByName(alone).select("article_id", "founder_id")
    raise RuntimeError("the gray band did not settle")
