"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of the byte n-grams of ``<word>``; a text is the mean of the
embeddings of all n-grams of all its words; two softmax outputs read the mean.
Embeddings and softmax are trained jointly in numpy with Adagrad, so a
misspelt or inflected word that was never seen shares vectors with known ones.
As the classifier is linear in the mean, each n-gram folds into one number
after training, and scoring is a sum over words.

The classifier is fitted on at most ``ROWS_PER_CLASS`` labelled rows of each
class, those with the smallest hash of the id; that bound is the only one.
Every whole text is scored.

Defined results: null and empty texts, and texts without words, score the
class balance of the fitted rows; without training rows of both classes the
score is that balance, or 0.5 where there is none; rows that repeat are scored
alike; an id that is labelled more than once has its largest label, and ids
whose documents repeat are learned once; texts are read whole at any length;
an empty table gives an empty result; other columns, ``labels.toxic``
included, are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold
from .storage import bounded_batches
from .textkernel import MULT, U64, mix64, raw_texts

ROWS_PER_CLASS = 1500
LENGTHS = (3, 4, 5)
BUCKET_BITS = 17
DIM = 8
STEPS = 1400
BATCH = 24
RATE = 0.5
HELD_OUT_FOLDS = 5
CACHED_WORDS = 600_000
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; marks at their ends are stripped when hashed."""
    return text.lower().split() if text else []


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all ``words``, and how many each word has."""
    framed = [b"<" + w.strip(_MARKS) + b">" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = np.frombuffer(b"".join(framed), np.uint8).astype(U64) + U64(1)
    owner = np.repeat(np.arange(len(framed)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # bytes to the word's end
    parts, owners = [], []
    rolling = np.zeros(len(codes), U64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(codes):
            break
        rolling = rolling[: len(codes) - n + 1] * MULT + codes[n - 1 :]
        if n in LENGTHS:
            whole = np.flatnonzero(left[: len(rolling)] >= n)
            parts.append((mix64(rolling[whole]) >> U64(64 - BUCKET_BITS)).astype(np.int32))
            owners.append(owner[whole])
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    buckets, owners = np.concatenate(parts), np.concatenate(owners)
    return buckets[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _text_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct buckets and their share of the text; with lengths."""
    buckets, shares, sizes = [], [], []
    for text in texts:
        own, _ = ngram_buckets(words_of(text)) if text and text.strip() else (np.zeros(0, np.int32), None)
        distinct, counts = np.unique(own, return_counts=True)
        buckets.append(distinct)
        shares.append((counts / max(1, len(own))).astype(np.float32))
        sizes.append(len(distinct))
    return np.concatenate(buckets), np.concatenate(shares), np.array(sizes)


def train(texts: list[bytes | None], toxic: np.ndarray, *, steps: int = STEPS, seed: int = 11):
    """(table, bias): what each bucket adds to the log odds, and the offset."""
    n_buckets = 1 << BUCKET_BITS
    toxic = np.asarray(toxic, np.int64)
    if not len(toxic):
        return np.zeros(n_buckets, np.float32), 0.0
    positive = toxic.mean()
    if not 0 < positive < 1:
        odds = np.clip(positive, 0.01, 0.99)
        return np.zeros(n_buckets, np.float32), float(np.log(odds / (1 - odds)))
    rng = np.random.default_rng(seed)
    buckets, shares, sizes = _text_features(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    embed = rng.uniform(-1 / DIM, 1 / DIM, (n_buckets, DIM)).astype(np.float32)
    output = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    embed_sum = np.full((n_buckets, DIM), 1e-8, np.float32)
    output_sum, offset_sum = np.full_like(output, 1e-8), np.full_like(offset, 1e-8)
    batch = min(BATCH, max(4, len(toxic) // 16))
    epochs = max(5, -(-steps * batch // len(toxic)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(toxic))
        for first in range(0, len(order), batch):
            rows = order[first : first + batch]
            at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            own, weight = buckets[at], shares[at]
            mean = np.zeros((len(rows), DIM), np.float32)
            if len(own):
                vectors = embed[own] * weight[:, None]
                for k in range(DIM):
                    mean[:, k] = np.bincount(owner, vectors[:, k], len(rows))
            logits = mean @ output + offset
            logits -= logits.max(1, keepdims=True)
            odds = np.exp(logits)
            odds /= odds.sum(1, keepdims=True)
            odds[np.arange(len(rows)), toxic[rows]] -= 1
            odds /= len(rows)
            to_mean = odds @ output.T
            to_output, to_offset = mean.T @ odds, odds.sum(0)
            if len(own):
                distinct, where = np.unique(own, return_inverse=True)
                step = np.empty((len(distinct), DIM), np.float32)
                for k in range(DIM):
                    step[:, k] = np.bincount(where, weight * to_mean[owner, k], len(distinct))
                embed_sum[distinct] += step * step
                embed[distinct] -= rate * step / np.sqrt(embed_sum[distinct])
            output_sum += to_output**2
            output -= rate * to_output / np.sqrt(output_sum)
            offset_sum += to_offset**2
            offset -= 0.1 * rate * to_offset / np.sqrt(offset_sum)
    return (embed @ (output[:, 1] - output[:, 0])).astype(np.float32), float(offset[1] - offset[0])


class Scorer:
    """Scores of whole texts from a folded table, with a bounded word cache."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.counts = np.zeros(1024), np.zeros(1024)

    def _learn(self, words: list[bytes]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        n = len(self.known)
        while n + len(fresh) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        buckets, sizes = ngram_buckets(fresh)
        owner = np.repeat(np.arange(len(fresh), dtype=np.int32), sizes)
        self.sums[n : n + len(fresh)] = np.bincount(owner, self.table[buckets], len(fresh))
        self.counts[n : n + len(fresh)] = sizes
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        flat = [w for words in split for w in words]
        try:
            at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            if len(self.known) > CACHED_WORDS:
                self._reset()
            self._learn(flat)
            at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
        total = np.bincount(owner, self.sums[at], len(split))
        count = np.bincount(owner, self.counts[at], len(split))
        logit = np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)
        return 1 / (1 + np.exp(-logit))


def training_rows(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, one for each id."""
    learnable = labels.select(
        F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "toxic").alias("tag")
    ).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
    chosen = bounded_sample(learnable, "toxic", "tag", rows_per_class).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    return texts.groupBy("doc_id").agg(one, F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, **options):
    """Train on the bounded sample of labelled rows; it fits the driver."""
    rows = training_rows(docs, labels, **options).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = raw_texts(rows.column("text")) if rows.num_rows else []
    return train(texts, np.array(rows.column("toxic").to_pylist(), np.int64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    bounded_batches(docs.sparkSession)
    table, bias = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((table, bias))  # 2**BUCKET_BITS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                own = scorer(raw_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
