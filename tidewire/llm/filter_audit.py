"""Filter interaction audit over a packed bitmap index.

What a filter removes depends on those before it.  The index holds, for each
block of rows of a partition and each part in it, bitsets of that part's rows:
one for membership, one for each filter (set: the row fails) and one for each
label.  A block's rows are ordered by part first, so a part's bitsets cover its
own rows alone and all parts of a block together take a bit for each row.

For every subset of filters the rows kept are the members AND NOT the union of
its filters; a popcount of that, and of it AND each label, are all that the
audit needs, whatever the order: the counts of the prefixes before and after a
step give what the step does.  Counts of blocks are summed; there are 2^n for
each part, from which the rows of all n! orders follow.

Defined results: null and empty texts are one text without words; null and
empty languages are one part; a null id is no later and no earlier copy and has
no label; rows that repeat an id are rows of their own, and equal texts of equal
ids are no copies of one another; labels that repeat an id hold if any row says
so; texts are read whole, at any length; an empty table gives an empty result;
columns other than those named are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import ensure_importable

from .storage import bounded_batches, work_folder, written
from .textkernel import raw_texts

BLOCK_ROWS = 1 << 16
MOST_FILTERS = 7
CAPITALS, SIGNS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def text_fails(raw: bytes) -> tuple[bool, bool, bool, bool]:
    """Too short, too repetitive, too many capitals, signs of code or tables."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * capitals > 10 * len(raw.translate(None, INNER)),  # code points
        len(raw.translate(None, SIGNS)) < len(raw),
    )


def _flagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t or b"" for t in raw_texts(batch.column(2))]
        fails = zip(*map(text_fails, raw), strict=True) if raw else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(f, pa.bool_()) for f in fails),
             pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())],
            ["doc_id", "part", "A", "B", "C", "D", "digest"])


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document.

    E: an equal text has a smaller id.  Only digests that repeat are joined, each
    with its smallest id, so a text of very many copies is one row on one side
    and its rows on the other can be split.
    """
    bounded_batches(docs.sparkSession, 256)
    ensure_importable(docs.sparkSession)
    folder = work_folder(docs.sparkSession, "filter-audit")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(
        _flagger, f"doc_id {kind}, part string, A boolean, B boolean, C boolean, D boolean, digest binary"), f"{folder}/flags")
    repeats = rows.groupBy("digest").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeats = written(repeats.select("digest", "earliest"), f"{folder}/repeats")
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    known = labels.groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = written(known, f"{folder}/labels")
    joined = rows.join(repeats, "digest", "left").join(known, "doc_id", "left")
    false = F.lit(False)
    return joined.select(
        "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("earliest"), false).alias("E"),
        F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))


def bitmap_index(rows: DataFrame, filters: list[str], labels: list[str], *, part: str = "part", block: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block and part: ``members`` and a bitset for each filter
    and label, in whole 64-bit words."""
    names = [*filters, *labels]

    def packed(parts: list[str], flags: np.ndarray) -> pa.RecordBatch:
        own, code = np.unique(np.array(parts, object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(own))).tolist()
        columns: list[list[bytes]] = [[] for _ in range(len(names) + 1)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            held = flags[:, order[a:b]]
            for column, bits in zip(columns, [np.ones(b - a, bool), *held], strict=True):
                bits = np.packbits(bits).tobytes()
                column.append(bits + bytes(-len(bits) % 8))
        return pa.RecordBatch.from_arrays(
            [pa.array(own.tolist(), pa.string()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "members", *names])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[str] = []
        flags: list[np.ndarray] = []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            flags.append(np.array([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], bool).reshape(len(names), -1))
            if len(parts) >= block:
                yield packed(parts, np.concatenate(flags, 1))
                parts, flags = [], []
        if parts:
            yield packed(parts, np.concatenate(flags, 1))

    ensure_importable(rows.sparkSession)
    no = F.lit(False)
    chosen = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(n).cast("boolean"), no).alias(n) for n in names])
    return chosen.mapInArrow(index, "part string, members binary, " + ", ".join(f"`{n}` binary" for n in names))


def subset_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, subset, kept, a column for each label): rows that no filter of the
    subset fails; bit i of ``subset`` stands for filter i."""
    subsets = 1 << len(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("members", *filters, *labels)}
            words = np.array([len(x) // 8 for x in batch.column("members").to_pylist()])
            starts = np.cumsum(words) - words
            failed = [np.zeros_like(bits["members"])]
            counts = []
            for subset in range(subsets):
                if subset:
                    low = (subset & -subset).bit_length() - 1
                    failed.append(failed[subset & (subset - 1)] | bits[filters[low]])
                kept = bits["members"] & ~failed[subset]
                counts.append([np.add.reduceat(np.bitwise_count(x).astype(np.int64), starts) for x in (kept, *(kept & bits[n] for n in labels))])
            parts = batch.column("part").to_pylist()
            columns = [np.concatenate([c[i] for c in counts]) for i in range(len(labels) + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts * subsets, pa.string()), pa.array(np.repeat(np.arange(subsets), len(parts)), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                ["part", "subset", "kept", *labels])

    found = index.mapInArrow(count, "part string, subset int, kept long, " + ", ".join(f"`{n}` long" for n in labels))
    return found.groupBy("part", "subset").agg(*[F.sum(n).alias(n) for n in ("kept", *labels)])


def audit(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from ``subset_counts``.

    ``kept``, ``removed``, ``redundant`` (fails, but was removed before),
    ``unique_fails`` (fails this filter alone), ``<label>_lost`` and ``shapley``:
    what the filter removes, summed over all orders.
    """
    n = len(filters)
    if n > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders")
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, at in enumerate(order, 1):
            steps.append((len(steps), "".join(filters[i] for i in order), step, 1 << at, before, before | 1 << at))
            before |= 1 << at
    spark = counts.sparkSession
    table = F.broadcast(spark.createDataFrame(steps, "number int, filter_order string, step int, bit int, before int, after int"))
    lists = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", *labels))).alias("c"))  # 2^n entries
    rows = lists.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(table, "number")
    at = lambda subset, name="kept": F.get("c", subset)[name]
    everything = F.lit((1 << n) - 1)
    removed = at(F.col("before")) - at(F.col("after"))
    rows = rows.select(
        "part", "filter_order", "step", "bit", at(F.col("after")).alias("kept"), removed.alias("removed"),
        (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(everything - F.col("bit")) - at(everything)).alias("unique_fails"),
        *[(at(F.col("before"), x) - at(F.col("after"), x)).alias(f"{x}_lost") for x in labels])
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    filters, marks = list("ABCDE"), ["good", "toxic"]
    index = bitmap_index(document_flags(docs, labels), filters, marks)
    return audit(subset_counts(index, filters, marks), filters, marks)
