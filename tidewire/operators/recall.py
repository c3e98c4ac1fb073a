"""Which stored events a new article may belong to, by similarity.

The vectors of an event's members meet the articles in blocks: an event is dealt
to one block as a whole, articles to one part and with it to all blocks (of the
neighbouring time bands, where a window bounds the search).  A part and a block
are a product of two matrices, of bounded size both; what leaves it are the pairs over the threshold and the best few of the gray band, so
pairs are never rows and nothing passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.greedy import GRAY_FLOOR, GRAY_PLACES, same_pairs, unit_rows

BLOCK_ROWS = 8000
PART_ROWS = 8000
LEFT_ROWS = 256
#: Scores that differ by less are ties.
DIGITS = 9


def _dealt(articles: DataFrame, members: DataFrame, seconds: float | None):
    """``articles`` (article_id, vec, at) and ``members`` (event_id, member_id,
    vec, at: the event's), met by (band, block, part)."""
    band = lambda c: F.lit(0).cast("long") if seconds is None else F.floor(F.unix_micros(c) / F.lit(int(seconds * 10**6)))
    members = members.withColumn("band", band("at"))
    blocks = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    right = members.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("event_id"), F.col("blocks")).cast("int"))
    near = [0] if seconds is None else [-1, 0, 1]
    left = articles.withColumn("band", F.explode(F.array(*[band("at") + n for n in near])))
    parts = left.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    left = left.join(blocks, "band").join(parts, "band").withColumn("part", F.pmod(F.xxhash64("article_id"), F.col("parts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.join(parts, "band").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = lambda df, *names: df.where("vec is not null").select(  # noqa: E731  columns of its own: both may come from one table
        *[F.col(n).alias(n) for n in ("band", "block", "part", *names, "vec")]).groupBy("band", "block", "part")
    return side(left, "article_id").cogroup(side(right, "event_id", "member_id"))


def _scored(threshold: float | None, floor: float | None, k: int, closest: bool):
    """A block's pairs: weakest member at the threshold or above, and the ``k``
    best centroids from the floor that aren't."""
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["event_id", "member_id"], kind="stable").reset_index(drop=True)
        out: dict[str, list] = {"article_id": [], "event_id": [], "gray": [], "similarity": [], "member_id": []}

        def found(i: int, g: int, gray: bool, value: float, member) -> None:
            for name, x in zip(out, (left.article_id.iat[i], events[g], gray, round(float(value), DIGITS), member), strict=True):
                out[name].append(x)

        if len(left) and len(right):
            raw, unit, widths = unit_rows(right.vec.tolist())
            _, wanted, own_widths = unit_rows(left.vec.tolist())
            names = right.event_id.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            events, members = names[starts], right.member_id.to_numpy()
            usable = widths == np.repeat(widths[starts], np.diff([*starts, len(right)]))
            means, _, _ = unit_rows(list(np.add.reduceat(np.where(usable[:, None], raw, 0), starts)))
            means /= np.where((size := np.linalg.norm(means, axis=1, keepdims=True)) > 0, size, 1)
            full = max(raw.shape[1], wanted.shape[1])
            unit, wanted, means = (np.pad(m, ((0, 0), (0, full - m.shape[1]))) for m in (unit, wanted, means))
            ends = [*starts[1:], len(right)]
            for first in range(0, len(left), LEFT_ROWS):
                rows = slice(first, first + LEFT_ROWS)
                near = np.where(widths[None, :] == own_widths[rows, None], wanted[rows] @ unit.T, 0.0)
                weakest = np.minimum.reduceat(near, starts, axis=1)
                if threshold is not None:
                    for i, g in zip(*np.nonzero(weakest >= threshold), strict=True):
                        found(first + i, g, False, weakest[i, g], None)
                if floor is None:
                    continue
                recall = np.where(widths[starts][None, :] == own_widths[rows, None], wanted[rows] @ means.T, 0.0)
                keep = recall >= floor
                if threshold is not None:
                    keep &= weakest < threshold
                for i in np.flatnonzero(keep.any(1)).tolist():
                    held = np.flatnonzero(keep[i])
                    best = held[np.lexsort((held, -recall[i, held].round(DIGITS)))][:k]
                    for g in best.tolist():
                        at = starts[g] + int(near[i, starts[g] : ends[g]].argmax()) if closest else 0
                        found(first + i, g, True, recall[i, g], members[at] if closest else None)
        return pd.DataFrame(out, dtype=object)

    return score


def _kinds(*columns: tuple[DataFrame, str]) -> list[str]:
    return [df.schema[name].dataType.simpleString() for df, name in columns]


def centroid_recall(articles: DataFrame, events: DataFrame, *, floor: float = GRAY_FLOOR, k: int = GRAY_PLACES) -> DataFrame:
    """Per article the ``k`` events with the nearest centroids above the floor.

    ``articles``: article_id, vec; ``events``: event_id, centroid.
    """
    members = events.select("event_id", F.lit(0).alias("member_id"), F.col("centroid").cast("array<double>").alias("vec"), F.lit(None).cast("timestamp").alias("at"))
    left = articles.select("article_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(None).cast("timestamp").alias("at"))
    article, event = _kinds((articles, "article_id"), (events, "event_id"))
    found = _dealt(left, members, None).applyInPandas(
        _scored(None, floor, k, False), f"article_id {article}, event_id {event}, gray boolean, similarity double, member_id int")
    order = Window.partitionBy("article_id").orderBy(F.desc("similarity"), "event_id")
    return found.select("article_id", "event_id", F.col("similarity").alias("affinity"), F.row_number().over(order).alias("place")).where(F.col("place") <= k)


def similar_members(articles: DataFrame, members: DataFrame, *, threshold: float, window_hours: float) -> DataFrame:
    """(article_id, event_id, similarity): events all of whose members are similar.

    ``articles``: article_id, vec, at; ``members``: event_id, member_id, vec, at
    (the event's).  Both times lie within the window, or a little beyond.
    """
    article, event, member = _kinds((articles, "article_id"), (members, "event_id"), (members, "member_id"))
    return _dealt(articles, members, window_hours * 3600).applyInPandas(
        _scored(threshold, None, 0, False), f"article_id {article}, event_id {event}, gray boolean, similarity double, member_id {member}")


def fits_window(last: Column, first: Column, event_first: Column, event_last: Column, hours: float) -> Column:
    """Whether an event was seen lately enough and both together last no longer than ``hours``."""
    micros = int(hours * 3600 * 10**6)
    joint = F.unix_micros(F.greatest(last, event_last)) - F.unix_micros(F.least(first, event_first))
    return (F.unix_micros(event_last) >= F.unix_micros(last) - micros) & (joint <= micros)


def nearest_events(
    articles: DataFrame, events: DataFrame, members: DataFrame, *, threshold: float, window_hours: float, k: int = 1,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """(article_id, event_id, similarity, gray, place): stored events for new articles.

    ``articles``: article_id, vec, first_seen_at, last_seen_at (of the article or
    of the group it leads); ``events``: event_id, first_seen_at, last_seen_at;
    ``members``: event_id, member_id, vec.  An event must have been seen within
    the window, and with the article last no longer.  It is judged by the least
    similar of *all* its members, however old: at the threshold or above it is a
    match, the most similar first, of equals the smallest id.

    With ``verdicts`` (low_id, high_id, same) a match needs one for each member.
    An article without a match then asks about two events of the gray band: those
    with the most similar centroids from the floor among *all* events below the
    threshold (one outside the window takes its place, and is not asked); the
    answer for the member nearest to the article decides.
    """
    spans = events.select("event_id", F.col("first_seen_at").alias("_first"), F.col("last_seen_at").alias("_last"))
    held = members.select("event_id", "member_id", F.col("vec").cast("array<double>").alias("vec")).join(
        spans.select("event_id", F.col("_last").alias("at")), "event_id")
    left = articles.select("article_id", F.col("vec").cast("array<double>").alias("vec"), F.col("last_seen_at").alias("at"))
    article, event, member = _kinds((articles, "article_id"), (events, "event_id"), (members, "member_id"))
    asks = verdicts is not None
    found = _dealt(left, held, None if asks else window_hours * 3600).applyInPandas(
        _scored(threshold, GRAY_FLOOR if asks else None, GRAY_PLACES, asks),
        f"article_id {article}, event_id {event}, gray boolean, similarity double, member_id {member}")
    best = Window.partitionBy("article_id", "gray").orderBy(F.desc("similarity"), "event_id")
    if asks:
        found = found.withColumn("_at", F.row_number().over(best)).where(~F.col("gray") | (F.col("_at") <= GRAY_PLACES)).drop("_at")
    own = articles.select("article_id", "first_seen_at", "last_seen_at")
    found = found.join(own, "article_id").join(spans, "event_id").where(
        fits_window(F.col("last_seen_at"), F.col("first_seen_at"), F.col("_first"), F.col("_last"), window_hours)).drop("first_seen_at", "last_seen_at", "_first", "_last")
    if asks:
        friends = same_pairs(verdicts).withColumnRenamed("friend", "member_id")
        gray = found.where("gray").join(friends, ["article_id", "member_id"], "left_semi")
        every = members.groupBy("event_id").agg(F.count_distinct("member_id").alias("_n"))
        agreed = found.where("not gray").drop("member_id").join(members.select("event_id", "member_id").distinct(), "event_id").join(
            friends, ["article_id", "member_id"], "left_semi").groupBy("article_id", "event_id", "gray", "similarity").agg(F.count(F.lit(1)).alias("_yes"))
        direct = agreed.join(every, "event_id").where("_yes = _n")
        columns = ["article_id", "event_id", "gray", "similarity"]
        found = direct.select(*columns).unionByName(gray.select(*columns))
    order = Window.partitionBy("article_id").orderBy("gray", F.desc("similarity"), "event_id")
    places = F.row_number().over(order)
    direct_too = F.min("gray").over(Window.partitionBy("article_id"))
    return found.withColumn("place", places).withColumn("_direct", ~direct_too).where(
        F.when(F.col("gray"), ~F.col("_direct") & (F.col("place") == 1)).otherwise(F.col("place") <= k)).select(
        "article_id", "event_id", "similarity", "gray", "place")
