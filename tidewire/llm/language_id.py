"""Language ID: nearest centroid over TF-IDF n-gram vectors.

A text is the vector of its byte n-grams (1 to 4 bytes, A-Z lower-cased, runs
of ASCII bytes other than letters as one space), hashed to ``DIM`` slots, weighed by
``log(1 + tf) * idf`` and brought to unit length.  Each language has up to
``CENTROIDS`` centroids from spherical k-means, so that styles within a
language keep their own.  A text takes the language of the centroid with the
largest cosine.  It is *rejected* when that cosine lies below the floor of that
language for texts of this length: short texts are far from every centroid, so
each language's floors come from pieces of its training texts of 8, 16, ...
bytes (three lengths of each text), as a share of a low quantile of what the
pieces reach.

The classifier is fitted on at most ``ROWS_PER_LANGUAGE`` rows of each
language, those with the smallest hash of the row, and for the ``MOST_KEYS``
languages with the most rows, which bounds the model in bytes; a text of another
language gets the nearest of these.
n-grams are counted where the rows are, document frequencies are summed by
slot, and each language is clustered by one task; the driver gets the
centroids alone.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; so is every text when there is nothing to learn from; rows
that repeat are treated alike; ties go to the first language by code point;
an empty table gives an empty result; texts are read whole at any length;
other columns are never read, and ``accepted`` passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold
from .storage import bounded_batches, work_folder, written
from .textkernel import MULT, U64, mix64, raw_texts

ROWS_PER_LANGUAGE = 600
DIM_BITS = 13
DIM = 1 << DIM_BITS
LONGEST = 4
CENTROIDS = 4
FLOOR_SHARE = 0.6
FLOOR_QUANTILE = 0.01
LENGTH_BITS = range(3, 12)
PIECE_SHARE = 3
DENSE_ROWS = 64
HELD_OUT_FOLDS = 3
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()


def has_letter(text: bytes | None) -> bool:
    """Whether any character is a letter (not a number sign such as a half)."""
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def letters(text: bytes) -> bytes:
    """What n-grams are taken from: letters, with one space between runs."""
    return b" " + b" ".join(text.translate(_LETTERS_ONLY).split()) + b" "


def slot_counts(framed: bytes) -> np.ndarray:
    """How often each slot's n-grams occur in all of ``framed``."""
    codes = np.frombuffer(framed, np.uint8).astype(U64)
    out = np.zeros(DIM, np.int64)
    rolling = np.zeros(len(codes), U64)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        rolling = rolling[: len(codes) - n + 1] * MULT + codes[n - 1 :]
        out += np.bincount((mix64(rolling) >> U64(64 - DIM_BITS)).astype(np.int64), minlength=DIM)
    return out


def length_bin(size: int) -> int:
    """Place of a length in ``LENGTH_BITS``."""
    return min(max(size.bit_length() - 1, LENGTH_BITS[0]), LENGTH_BITS[-1]) - LENGTH_BITS[0]


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of unit length (zero rows stay zero)."""
    rows = np.log1p(counts, dtype=np.float32)
    rows *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    rows /= np.where(norm > 0, norm, np.float32(1))
    return rows


def spherical_means(rows: np.ndarray, k: int, *, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` unit centroids; starts far apart, so no seed is needed."""
    picked = [int(np.argmax(rows @ rows.mean(0)))]
    while len(picked) < min(k, len(rows)):
        picked.append(int(np.argmin((rows @ rows[picked].T).max(1))))
    centres = rows[picked]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[nearest == i].sum(0) for i in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


class Model:
    """Centroids with their languages, and each language's rejection floors."""

    def __init__(self, languages: list[str], idf, centres, owners, floors):
        self.languages, self.idf = languages, idf
        self.centres, self.owners, self.floors = centres, owners, floors

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and rejections."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for first in range(0, len(known), DENSE_ROWS):
            some = known[first : first + DENSE_ROWS]
            framed = [letters(texts[i]) for i in some]
            cosines = unit_rows(np.stack([slot_counts(f) for f in framed]), self.idf) @ self.centres.T
            best = cosines.argmax(1)
            near = cosines[np.arange(len(some)), best].tolist()
            for i, f, c, cosine in zip(some, framed, best.tolist(), near, strict=True):
                langs[i] = self.languages[self.owners[c]]
                scores[i] = min(1.0, max(0.0, cosine))
                rejected[i] = cosine < self.floors[self.owners[c], length_bin(len(f))]
        return langs, scores, rejected


def training_rows(docs: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """A bounded sample of learnable rows: text and lang outside the held-out fold."""
    learnable = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("tag"), fold(F.col("doc_id"), HELD_OUT_FOLDS).alias("_fold"),
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("_fold") != 1)).drop("_fold")
    return bounded_sample(learnable, "lang", "tag", rows_per_language)


_COUNTED = "lang string, tag long, piece int, slots array<int>, counts array<int>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse n-gram counts of each text (piece -1) and of pieces of every third length."""
    for whole in batches:
        for first in range(0, whole.num_rows, DENSE_ROWS):
            batch = whole.slice(first, DENSE_ROWS)
            tags, owners, pieces, slots, counts = batch.column(2).to_pylist(), [], [], [], []
            for row, text in enumerate(raw_texts(batch.column(1))):
                if not has_letter(text):
                    continue
                framed = letters(text)
                parts = [(-1, framed)]
                for i, bits in enumerate(LENGTH_BITS):
                    if len(framed) >= 1 << bits and (tags[row] + i) % PIECE_SHARE == 0:
                        at = tags[row] % (len(framed) - (1 << bits) + 1)
                        parts.append((i, framed[at : at + (1 << bits)]))
                for piece, part in parts:
                    own = slot_counts(part)
                    at = np.flatnonzero(own)
                    owners.append(row)
                    pieces.append(piece)
                    slots.append(at.astype(np.int32))
                    counts.append(own[at].astype(np.int32))
            rows = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(pieces, pa.int32()),
                 pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["lang", "tag", "piece", "slots", "counts"],
            )


def _unit_blocks(table: pa.Table, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Unit rows of sparse counts, ``DENSE_ROWS`` at a time."""
    for first in range(0, table.num_rows, DENSE_ROWS):
        part = table.slice(first, DENSE_ROWS)
        slots, counts = part["slots"].combine_chunks(), part["counts"].combine_chunks()
        out = np.zeros((len(slots), DIM), np.int32)
        owner = np.repeat(np.arange(len(slots)), pa.compute.list_value_length(slots).to_numpy())
        out[owner, slots.flatten().to_numpy()] = counts.flatten().to_numpy()
        yield unit_rows(out, idf)


def _language_fitter(idf: np.ndarray, centroids: int):
    def fit_one(rows: pa.Table) -> pa.Table:
        """Centroids and floors of one language, from its bounded sample."""
        rows = rows.sort_by([("tag", "ascending")])
        piece = rows["piece"].to_numpy()
        whole = rows.filter(pa.array(piece == -1))
        vectors = np.empty((whole.num_rows, DIM), np.float32)
        for i, block in enumerate(_unit_blocks(whole, idf)):
            vectors[i * DENSE_ROWS : i * DENSE_ROWS + len(block)] = block
        found = spherical_means(vectors, centroids)
        floors, last = [], 0.0
        for i in range(len(LENGTH_BITS)):
            near = [(block @ found.T).max(1) for block in _unit_blocks(rows.filter(pa.array(piece == i)), idf)]
            if near:
                last = FLOOR_SHARE * float(np.quantile(np.concatenate(near), FLOOR_QUANTILE))
            floors.append(last)
        lang = rows["lang"][0].as_py()
        return pa.table(
            {"lang": pa.array([lang] * len(found), pa.string()),
             "centre": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary()),
             "floors": pa.array([floors] * len(found), pa.list_(pa.float64()))}
        )

    return fit_one


def fit(docs: DataFrame, *, centroids: int = CENTROIDS, **options) -> Model:
    """Count on the executors, cluster each language in a task of its own."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = training_rows(docs, **options).mapInArrow(_count, _COUNTED)
    counted = written(counted, f"{work_folder(spark, 'langid')}/counted")
    whole = counted.where("piece = -1")
    seen = whole.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect()  # at most DIM rows
    frequency = np.zeros(DIM)
    frequency[[r[0] for r in seen]] = [r[1] for r in seen]
    idf = (np.log((1 + whole.count()) / (1 + frequency)) + 1).astype(np.float32)
    made = counted.groupBy("lang").applyInArrow(
        _language_fitter(idf, centroids), "lang string, centre binary, floors array<double>"
    ).collect()  # a few centroids for each language
    made.sort(key=lambda r: (r.lang.encode(), r.centre))
    languages = sorted({r.lang for r in made})
    floors = {r.lang: r.floors for r in made}
    return Model(
        languages, idf, np.array([np.frombuffer(r.centre, "<f4") for r in made], np.float32).reshape(-1, DIM),
        np.array([languages.index(r.lang) for r in made], np.int64),
        np.array([floors[x] for x in languages]).reshape(-1, len(LENGTH_BITS)),
    )


def language_ids(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))  # DIM floats for each centroid

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                langs, scores, rejected = shared.value.predict(raw_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )
    return out.select(
        "doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                _, _, rejected = model.value.predict(raw_texts(part.column(at)))
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)
