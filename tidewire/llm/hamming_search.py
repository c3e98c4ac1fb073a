"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and each segment has its own hash table.  In
round r every open query probes each table with all segment values at distance
r from its own.  A code that no probe up to r has met differs by more than r
bits in each of the m segments, so by at least ``m * (r + 1)`` bits in all; a
query is done once its k-th verified distance is below that.

Before the first round each query gets an upper bound of that distance from a
bounded sample of codes: the k-th distance among some codes is never below
the one among all.  Candidates beyond the bound end inside the join.

Rows with equal codes are one entry that keeps its ``k + 1`` smallest ids, so
neither the probes nor the candidates grow with the number of copies.  A
candidate counts only in the round and segment where it is nearest, so none
is verified twice.  Queries that stay open when a round would probe more
values than there are codes are scanned against all codes in blocks of
``SCAN_QUERIES`` query codes, which is exact as well.

Defined results: rows without a vector, with a null or NaN component, or with
another width than ``bits`` have no code: they are neither found nor do they
search; a query never returns its own row; ties go to the smaller id; fewer
rows than k give as many as there are; rows that repeat an id are one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import work_folder, written

TOP_K = 10
BITS = 64
QUERY_EVERY = 50
SCAN_QUERIES = 4096
SAMPLE_CODES = 4096
BUCKET_BITS = 6


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """A long whose bit i is set where component i is above 0; null if unfit."""
    whole = (F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    parts = F.transform(vector, lambda x, i: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)))
    code = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.cast("long")))
    return F.when(whole, code)


def segment_bits(codes: int, bits: int = BITS) -> int:
    """Width of a segment: buckets of about ``2 ** BUCKET_BITS`` codes."""
    return max(8, min(bits, 24, round(log2(max(codes, 2))) - BUCKET_BITS))


def _segments(bits: int, width: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; the widths differ by one bit at most."""
    m = -(-bits // width)
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _around(code: Column, shift: int, width: int, radius: int) -> Column:
    """All values of a segment at distance ``radius`` from the code's own."""
    own = _part(code, shift, width)
    flips = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    return F.transform(F.lit(np.array(flips, np.int64)), lambda x: x.bitwiseXOR(own))


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest members per query code and row, ties by id."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded(codes: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Query codes with a bound of the distance of their k + 1 nearest rows."""
    sample = entries.orderBy(F.xxhash64("code")).limit(SAMPLE_CODES).select("code", F.size("ids").alias("n")).toPandas()
    known, copies = sample["code"].to_numpy(np.int64).view(np.uint64), sample["n"].to_numpy(np.int64)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q in batch.column(0).to_numpy().view(np.uint64):
                d = np.bitwise_count(known ^ q).astype(np.int64)
                upto = np.cumsum(np.bincount(d, copies, minlength=65))
                out.append(int(np.searchsorted(upto, k + 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["qcode", "bound"])

    return codes.mapInArrow(bound, "qcode long, bound long")


def _scan(entries: DataFrame, block: np.ndarray, k: int) -> DataFrame:
    """All entries against one block of query codes, k + 1 nearest of each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            for q in block.tolist():
                d = np.bitwise_count(codes ^ np.uint64(q & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)
                near = np.argsort(d, kind="stable")[: k + 1]
                limit = d[near[-1]] if len(near) else 0
                near = np.flatnonzero(d <= limit)
                own = best.setdefault(q, [])
                own += zip(d[near].tolist(), codes[near].view(np.int64).tolist(), strict=True)
                own.sort()
                if len(own) > k + 1:
                    cut = own[k][0]
                    best[q] = [x for x in own if x[0] <= cut]
        rows = [(q, c, d) for q, own in best.items() for d, c in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["qcode", "code", "distance"]
        )

    return entries.select("code").mapInArrow(scan, "qcode long, code long, distance long")


def _met(open_codes: DataFrame, index: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """Codes that a segment's values at ``radius`` from an open query's lead to.

    A query becomes thousands of probes, which estimates of sizes don't see, so
    the join is merged: broadcast, the probes would all pass through the driver.
    """
    probe = open_codes.select("qcode", "bound", F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("seg"),
            _around(F.col("qcode"), a, w, radius).alias("values"),
        )
        for s, (a, w) in enumerate(segments) if radius <= w
    ])).alias("x")).select("qcode", "bound", "x.seg", F.explode("x.values").alias("value"))
    apart = F.col("qcode").bitwiseXOR(F.col("code"))
    nearest = F.array(*[F.bit_count(_part(apart, a, w)) for a, w in segments])
    return (
        probe.hint("merge").join(index, ["seg", "value"])
        .where(F.bit_count(apart) <= F.col("bound"))
        .where((F.array_min(nearest) == radius) & (F.array_position(nearest, F.array_min(nearest)) == F.col("seg") + 1))
        .select("qcode", "code", F.bit_count(apart).cast("long").alias("distance"))
    )


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = TOP_K, bits: int = BITS) -> DataFrame:
    """(id, code) and (id, code) -> query_id, rank, id, distance."""
    spark = rows.sparkSession
    folder = work_folder(spark, "hamming")
    valid = rows.where("code is not null and id is not null").select("id", "code").distinct()
    by_code = Window.partitionBy("code").orderBy("id")
    entries = written(
        valid.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= k + 1)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")),
        f"{folder}/entries",
    )
    n = entries.count()
    segments = _segments(bits, segment_bits(n, bits))
    m = len(segments)
    asked = written(
        queries.where("code is not null and id is not null").select(F.col("id").alias("qid"), F.col("code").alias("qcode"))
        .distinct(),
        f"{folder}/asked",
    )
    open_codes = written(_bounded(asked.select("qcode").distinct(), entries, k), f"{folder}/open-0")
    index = entries.select("code", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), _part(F.col("code"), a, w).alias("value")) for s, (a, w) in enumerate(segments)
    ])).alias("x")).select("code", "x.seg", "x.value")
    index = written(index, f"{folder}/index")
    found: list[DataFrame] = []
    for radius in range(max(w for _, w in segments) + 1):
        if open_codes.isEmpty():
            break
        probes = sum(comb(w, radius) for _, w in segments)
        if probes > max(n, 256):
            break
        met = _met(open_codes, index, segments, radius)
        found.append(written(met, f"{folder}/met-{radius}"))
        everything = found[0]
        for other in found[1:]:
            everything = everything.union(other)
        sized = everything.join(entries.select("code", F.size("ids").alias("copies")), "code")
        upto = Window.partitionBy("qcode").orderBy("distance", "code").rowsBetween(Window.unboundedPreceding, 0)
        covered = m * (radius + 1) - 1
        done = (
            sized.withColumn("total", F.sum("copies").over(upto))
            .where((F.col("total") >= k + 1) & (F.col("distance") <= covered))
            .select("qcode").distinct()
        )
        open_codes = written(open_codes.join(done, "qcode", "left_anti"), f"{folder}/open-{radius + 1}")
    block: list[int] = []

    def scanned(block: list[int]) -> None:
        found.append(written(_scan(entries, np.array(block, np.int64), k), f"{folder}/scan-{len(found)}"))

    opened = open_codes.select("qcode")
    known = written(opened, f"{folder}/rest")
    for row in known.toLocalIterator():
        block.append(row.qcode)
        if len(block) == SCAN_QUERIES:
            scanned(block)
            block = []
    if block:
        scanned(block)
    if not found:
        found.append(spark.createDataFrame([], "qcode long, code long, distance long"))
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.union(other)
    members = pairs.distinct().join(entries, "code").select("qcode", "distance", F.explode("ids").alias("id"))
    nearest = Window.partitionBy("qcode").orderBy("distance", "id")
    members = members.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1).drop("_n")
    answers = asked.join(members, "qcode").where("id <> qid")
    return _top(answers, k).select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


def embedding_search(embeddings: DataFrame, *, k: int = TOP_K, every: int = QUERY_EVERY) -> DataFrame:
    """Every vector whose id is divisible by ``every`` against all vectors."""
    rows = embeddings.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where(F.col("id") % every == 0), k=k)
