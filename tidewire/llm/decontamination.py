"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` neighbouring word k-grams the smallest hash is
kept, so two texts that share ``SPAN`` words share a kept fingerprint at the
same place.  The fingerprints of a document are joined with those of the
benchmark (a merge join of sorted hashes), and each hit is extended: every
window of ``SPAN`` words around it is held against the benchmark's windows.
Runs of matching windows give the whole shared span, so nothing of ``SPAN``
words or more is missed, and nothing shorter is reported.

A benchmark item with fewer than ``SPAN`` words is one window of its own
length; those lengths (at most ``SPAN - 1`` of them) are looked up directly.

Scale: documents are neither shuffled nor collected.  The benchmark is read in
blocks of at most ``BLOCK_WORDS`` words, whose index is what a broadcast
holds; each block is one pass over the documents, and the hit spans of the
passes are united per document.  A benchmark within one block, the usual
case, needs one pass and no shuffle.  An item longer than a block is cut into
pieces that overlap by ``SPAN - 1`` words.

Defined results: null texts have no words and no hits; items without words
match nothing; items that repeat are all reported; document rows that repeat
give one row each; a null document id is kept as it is and a null item id is
reported as an empty string; texts are read whole at any length; an empty
table of documents gives an empty result, an empty benchmark no hits; extra
columns are never read, whatever their names, and ``clean`` passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .storage import bounded_batches, work_folder, written
from .textkernel import U64, gram_hashes, mix64, raw_texts, word_hashes

SPAN = 10
GRAM = 5
BLOCK_WORDS = 4_000_000
#: Lower-cases A-Z, keeps digits, letters and bytes above 127, blanks the rest.
_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def item_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


def winnow(hashes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Positions of the fingerprints: each window's last smallest k-gram."""
    grams = mix64(gram_hashes(hashes, gram) ^ U64(0x5851F42D4C957F2D))
    width = span - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    last = width - 1 - np.argmin(windows[:, ::-1], axis=1)
    return np.unique(np.arange(len(windows)) + last)


class Lookup:
    """Sorted window hashes, each with the items that hold it."""

    def __init__(self, hashes: list[np.ndarray], items: list[int]):
        owners = np.repeat(np.array(items, np.int64), [len(h) for h in hashes])
        flat = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.lexsort((owners, flat))
        flat, owners = flat[order], owners[order]
        fresh = np.ones(len(flat), bool)
        fresh[1:] = (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1])
        flat, self.owners = flat[fresh], owners[fresh]
        self.hashes, starts = np.unique(flat, return_index=True)
        self.starts = np.append(starts, len(flat))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are here, and where."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, at[hit]

    def items(self, at: np.ndarray) -> np.ndarray:
        """Distinct items of the entries ``at``."""
        found = [self.owners[self.starts[a] : self.starts[a + 1]] for a in np.unique(at)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


class BenchmarkIndex:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = [name for name, _ in items]
        hashed = [word_hashes(words) for _, words in items]
        long = [i for i, h in enumerate(hashed) if len(h) >= SPAN]
        prints = [gram_hashes(hashed[i], GRAM)[winnow(hashed[i])] for i in long]
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.windows = Lookup([gram_hashes(hashed[i], SPAN) for i in long], long)
        self.short = {}
        for n in range(1, SPAN):
            own = [i for i, h in enumerate(hashed) if len(h) == n]
            if own:
                self.short[n] = Lookup([gram_hashes(hashed[i], n) for i in own], own)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Flags of the hit words, and the names of the items found."""
        hit = np.zeros(len(words) + 1, np.int64)
        found: list[np.ndarray] = []
        if not words:
            return hit[:0].astype(bool), []
        hashes = word_hashes(words)
        if len(hashes) >= SPAN and len(self.prints):
            kept = winnow(hashes)
            own = gram_hashes(hashes, GRAM)[kept]
            at = np.searchsorted(self.prints, own)
            at[at == len(self.prints)] = 0
            seeds = kept[self.prints[at] == own]
            if len(seeds):
                around = np.unique(seeds[:, None] - np.arange(SPAN - GRAM + 1))
                around = around[(around >= 0) & (around <= len(hashes) - SPAN)]
                which, entry = self.windows.find(gram_hashes(hashes, SPAN)[around])
                np.add.at(hit, around[which], 1)
                np.add.at(hit, around[which] + SPAN, -1)
                found.append(self.windows.items(entry))
        for n, lookup in self.short.items():
            if len(hashes) >= n:
                which, entry = lookup.find(gram_hashes(hashes, n))
                np.add.at(hit, which, 1)
                np.add.at(hit, which + n, -1)
                found.append(lookup.items(entry))
        items = np.unique(np.concatenate(found)) if found else []
        return np.cumsum(hit[:-1]) > 0, sorted({self.names[i] for i in items})


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of bounded size; long items in overlapping pieces."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for row in rows.toLocalIterator(prefetchPartitions=True):
        words = item_words(row.t.encode()) if row.t else []
        step = max(block_words, SPAN)
        for first in range(0, max(1, len(words) - SPAN + 1), step):
            piece = words[first : first + step + SPAN - 1] if len(words) >= SPAN else words
            if block and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            if piece:
                block.append((row.i or "", piece))
                held += len(piece)
    if block:
        yield block


def _spans(hit: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


_FOUND = [
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(IntegerType())),
    StructField("items", ArrayType(StringType())),
]


def _scan(rows: DataFrame, index: BenchmarkIndex | None) -> DataFrame:
    """The columns before ``text`` (the last) with word count, hit spans and items found."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_WORDS words
    keys = rows.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                sizes, spans, items = [], [], []
                for text in raw_texts(part.column(len(keys))):
                    words = item_words(text)
                    hit, names = own.scan(words) if own else (np.zeros(0, bool), [])
                    sizes.append(len(words))
                    spans.append(_spans(hit))
                    items.append(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(keys)],
                        pa.array(sizes, pa.int64()),
                        pa.array(spans, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*keys, "n_words", "spans", "items"],
                )

    return rows.mapInArrow(scan, StructType([*rows.schema.fields[:-1], *_FOUND]))


def benchmark_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``keys`` with n_words, spans of hit words and names of items found."""
    spark: SparkSession = docs.sparkSession
    blocks = _blocks(benchmark, block_words)
    first = next(blocks, None)
    second = next(blocks, None) if first else None
    rows = docs.select(
        F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), F.col("text").cast("string").alias("text")
    )
    if second is None:
        return _scan(rows, BenchmarkIndex(first) if first else None).select("key.*", "n_words", "spans", "items")
    folder = work_folder(spark, "overlaps")
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    numbered = written(numbered, f"{folder}/rows")
    passes, block, k = [], first, 0
    while block is not None:
        own = _scan(numbered.select("row", "text"), BenchmarkIndex(block))
        passes.append(written(own.where((F.size("spans") > 0) | F.lit(k == 0)), f"{folder}/pass-{k}"))
        block, second, k = second, next(blocks, None), k + 1
    union = passes[0]
    for other in passes[1:]:
        union = union.unionByName(other)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for lists, n in zip(batch.column("lists").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                flags = np.zeros(n, bool)
                for own in lists:
                    for a, b in zip(own[::2], own[1::2], strict=True):
                        flags[a:b] = True
                spans.append(_spans(flags))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n_words"), pa.array(spans, pa.list_(pa.int32())), batch.column("items")],
                names=["row", "n_words", "spans", "items"],
            )

    grouped = union.groupBy("row", "n_words").agg(
        F.collect_list("spans").alias("lists"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )  # at most one row for each pass in a group
    united = grouped.mapInArrow(unite, StructType([StructField("row", LongType()), *_FOUND]))
    return numbered.select("row", "key").join(united, "row").select("key.*", "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items found and whether any was."""
    rows = benchmark_overlaps(docs, benchmark, **options)
    ends = F.expr("aggregate(sequence(1, size(spans) div 2), 0L, (n, i) -> n + spans[2 * i - 1] - spans[2 * i - 2])")
    n_hit = F.when(F.size("spans") > 0, ends).otherwise(F.lit(0).cast("long"))
    joined = F.concat_ws(",", F.array_sort("items"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    folded = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    rows = benchmark_overlaps(folded, benchmark, keys=("whole",), **options)
    return rows.where(F.size("spans") == 0).select("whole.*")


def items_digest(names: list[str]) -> str:
    """The digest of a list of item ids, as the query returns it."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
