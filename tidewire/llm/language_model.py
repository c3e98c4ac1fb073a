"""LM scoring with an Elias-Fano n-gram trie.

The model is a bigram model with interpolated absolute discounting over an
add-one unigram model.  Its trie has two levels, in shards of bounded size in
the shared folder:

* ``words-k``: sorted word hashes, their training counts and prefix sums of
  those.  A word's id is its place over all shards; shard bases are prefix sums.
* ``trie-k``: the contexts that have kept successors (Elias-Fano), monotone
  pointers to their successors (Elias-Fano), back-off weights, and the
  successors themselves.  Successor ids restart in each context, so the last
  value before a context is added to them; the sum is one monotone Elias-Fano
  sequence, and a search is relative to its context.  Logs of the discounted
  shares and back-off weights are quantised to 8 bits, each shard with its own
  code books.

Every file is memory-mapped and read where it is needed; the driver holds one
line for each shard.  Counts cover all learnable documents: partial counts of
a task's texts are summed by key, so hot words and pairs meet pre-aggregated.
Pairs are dealt to shards by where they fall among all training tokens when
those are ordered by (context, word): the tokens before the context, and of its
own the share that the smaller words have in the corpus.  So shards follow from
the word counts alone and hold about as many tokens each.  A context may be
split between shards; ``trie.json`` has the back-off weights of those.  Every
pair is kept; a caller who wants a smaller model may leave pairs seen less than
``least_pair`` times to the back-off weight.

Defined results: a null or empty text is one end token; words that were never
seen have c = 0; without training rows every count is 0, N and V are 0 and
both scores are those of the add-one formula; rows that repeat count and score
as often as they occur; extra columns are never read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import fold
from .elias_fano import EliasFano, flat, open_pack, write_pack
from .storage import bounded_batches, get_bytes, put_file, work_folder, written
from .textkernel import U64, raw_texts, word_hashes

FOLDS = 7
HELD_OUT = 2
DISCOUNT = 0.75
LEAST_PAIR = 1
OPEN_SHARDS = 512
BATCH_TOKENS = 2_000_000
SHARD_ROWS = 2_000_000
#: A line feed is never inside a word, so this hash is the end token's own.
END = xxh3_64_intdigest(b"\n")


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, and the number in each text."""
    words: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split() if text else []
        own.append(b"\n")
        words += own
        sizes[i] = len(own)
    return word_hashes(words), sizes


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of bounded text, with their tokens."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.num_columns - 1).cast(pa.binary())
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32, offset=column.offset * 4, count=len(column) + 1))
        piece = np.cumsum(lengths, dtype=np.int64) // (BATCH_TOKENS * 4)
        for first in np.unique(piece, return_index=True)[1].tolist():
            part = batch.slice(first, int(np.searchsorted(piece, piece[first], side="right")) - first)
            hashes, sizes = _tokens(raw_texts(part.column(part.num_columns - 1)))
            yield part, hashes, sizes


def _token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and text sizes of many batches together, about ``BATCH_TOKENS``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, hashes, sizes in _token_batches(batches):
        held.append((hashes, sizes))
        if sum(len(h) for h, _ in held) >= BATCH_TOKENS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hashes, _ in _token_runs(batches):
        words, counts = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["h", "c"])


def _word_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        words = (np.concatenate([p[0] for p in parts]) ^ np.int64(-(2**63))).view(U64)
        counts = np.concatenate([p[1] for p in parts])
        k = TaskContext.get().partitionId()
        starts = np.cumsum(counts) - counts
        write_pack(f"{folder}/words-{k}", {"words": words, "counts": counts, "starts": starts})
        yield pa.RecordBatch.from_pydict(
            {"k": [k], "first": [int(words[0]).to_bytes(8, "big").hex()], "n": [len(words)], "total": [int(counts.sum())]}
        )

    return write


class Vocabulary:
    """Word ids and counts from the mapped word shards."""

    def __init__(self, folder: str):
        about = json.loads(get_bytes(f"{folder}/words.json"))
        self.tokens, self.size = about["tokens"], about["words"]
        shards = about["shards"]
        self.first = np.array([int(s["first"], 16) for s in shards], U64)
        self.base = np.array([s["base"] for s in shards] + [self.size], np.int64)
        packs = [open_pack(f"{folder}/words-{s['k']}") for s in shards]
        self.words = [p["words"] for p in packs]
        self.counts = [p["counts"] for p in packs]
        self.starts = [p["starts"] for p in packs]
        self.before = [s["before"] for s in shards]

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 if unseen) and counts of sorted distinct hashes."""
        ordered = sorted_hashes ^ U64(2**63)  # the shards are in signed order
        rank = np.argsort(ordered, kind="stable")
        ordered = ordered[rank]
        ids, counts = np.full(len(ordered), -1, np.int64), np.zeros(len(ordered), np.int64)
        cuts = np.searchsorted(ordered, self.first[1:]) if len(self.first) else []
        edges = [0, *cuts, len(ordered)]
        for k, (words, own) in enumerate(zip(self.words, self.counts, strict=True)):
            part = ordered[edges[k] : edges[k + 1]]
            at = np.searchsorted(words, part)
            at[at == len(words)] = 0
            hit = np.flatnonzero(words[at] == part)
            ids[edges[k] + hit] = self.base[k] + at[hit]
            counts[edges[k] + hit] = own[at[hit]]
        out_ids, out_counts = np.empty_like(ids), np.empty_like(counts)
        out_ids[rank], out_counts[rank] = ids, counts
        return out_ids, out_counts

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts by id."""
        return self._by_id(self.counts, [0] * len(self.counts), ids)

    def start_of(self, ids: np.ndarray) -> np.ndarray:
        """Training tokens with a smaller id, by id."""
        return self._by_id(self.starts, self.before, ids)

    def _by_id(self, arrays: list[np.ndarray], plus: list[int], ids: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.base, ids, side="right") - 1
        out = np.empty(len(ids), np.int64)
        for k in np.unique(shard):
            own = shard == k
            out[own] = arrays[k][ids[own] - self.base[k]] + plus[k]
        return out


def _pair_counter(folder: str, shard_rows: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder)
        for hashes, sizes in _token_runs(batches):
            distinct, place = np.unique(hashes, return_inverse=True)
            ids, counts = words.find(distinct)
            starts = words.start_of(ids)
            end = int(np.searchsorted(distinct, U64(END)))
            before = np.empty_like(place)
            before[1:] = place[:-1]
            before[np.cumsum(sizes) - sizes] = end
            keys, n = np.unique((before.astype(np.int64) << 32) | place, return_counts=True)
            u, w = keys >> 32, keys & 0xFFFFFFFF
            inside = np.minimum((counts[u] * (starts[w] / words.tokens)).astype(np.int64), counts[u] - 1)
            k = ((starts[u] + inside) // shard_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(ids[u]), pa.array(ids[w]), pa.array(n)], names=["k", "u", "w", "c"]
            )

    return count


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of values and the code book: means of 256 even shares."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    edges = np.quantile(values, np.linspace(0, 1, 257)[1:-1])
    codes = np.searchsorted(edges, values, side="right").astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    return codes, np.bincount(codes, values, 256) / np.maximum(n, 1)


def _trie_writer(folder: str, least_pair: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not parts:
            return
        words = Vocabulary(folder)
        k, u, w, c = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        span = U64(words.size)
        keys = u.astype(U64) * span + w.astype(U64)
        order = np.argsort(keys)  # the shard never falls as the key rises
        keys, k, c = keys[order], k[order], c[order]
        del u, w, order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, k, c = keys[first], k[first], np.add.reduceat(c, first)
        kept = c >= least_pair
        keys, k, c = keys[kept], k[kept], c[kept]
        for shard in np.unique(k).tolist():
            own = k == shard
            u, w = (keys[own] // span).astype(np.int64), (keys[own] % span).astype(np.int64)
            yield write_shard(words, shard, u, w, c[own])

    def write_shard(words: Vocabulary, k: int, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        contexts, starts = np.unique(u, return_index=True)
        seen = words.count_of(contexts)
        sizes = np.diff(np.append(starts, len(u)))
        mass = np.add.reduceat(c, starts) - DISCOUNT * sizes
        owner = np.repeat(np.arange(len(contexts)), sizes)
        codes, book = _codes(np.log10((c - DISCOUNT) / seen[owner]))
        bow_codes, bow_book = _codes(np.log10(np.maximum(1 - mass / seen, 1e-12)))
        ends = np.append(starts[1:], len(u)) - 1
        bases = np.concatenate([[0], np.cumsum(w[ends] + 1)])
        pack = {"codes": codes, "book": book, "bow_codes": bow_codes, "bow_book": bow_book}
        pack |= flat("contexts", EliasFano.encode(contexts))
        pack |= flat("pointers", EliasFano.encode(np.append(starts, len(u))))
        pack |= flat("bases", EliasFano.encode(bases))
        pack |= flat("successors", EliasFano.encode(bases[owner] + w))
        write_pack(f"{folder}/trie-{k}", pack)
        return pa.RecordBatch.from_pydict(
            {"k": [k], "u": [int(u[0])], "w": [int(w[0])], "last": [int(u[-1])], "n": [len(u)],
             "mass": [float(mass[0])], "last_mass": [float(mass[-1])], "last_seen": [int(seen[-1])]}
        )

    return write


class TrieShard:
    """One mapped shard of the second level."""

    def __init__(self, uri: str):
        arrays = open_pack(uri)
        self.codes, self.book = arrays["codes"], np.asarray(arrays["book"])
        self.bow_codes, self.bow_book = arrays["bow_codes"], np.asarray(arrays["bow_book"])
        self.contexts, self.pointers, self.bases, self.next = (
            EliasFano.open(arrays, name) for name in ("contexts", "pointers", "bases", "successors")
        )

    def look_up(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log discounted share (NaN where not kept) and log back-off weight."""
        logp, bow = np.full(len(u), np.nan), np.zeros(len(u))
        distinct, place = np.unique(u, return_inverse=True)
        at = self.contexts.successors(distinct)
        there = np.flatnonzero(at < self.contexts.size)
        there = there[self.contexts[at[there]] == distinct[there].astype(U64)]
        local = np.full(len(distinct), -1, np.int64)
        local[there] = at[there]
        rows = np.flatnonzero(local[place] >= 0)
        mine = local[place[rows]]
        bow[rows] = self.bow_book[self.bow_codes[mine]]
        used, back = np.unique(mine, return_inverse=True)
        base = self.bases[used].astype(np.int64)
        first, last = self.pointers[used].astype(np.int64), self.pointers[used + 1].astype(np.int64)
        want = base[back] + np.maximum(w[rows], 0)
        found = self.next.successors(want)
        hit = (found >= first[back]) & (found < last[back]) & (w[rows] >= 0)
        hit[hit] = self.next[found[hit]] == want[hit].astype(U64)
        logp[rows[hit]] = self.book[self.codes[found[hit]]]
        return logp, bow


class Trie:
    """Routes sorted (context, word) keys to the shards that may hold them."""

    def __init__(self, folder: str):
        self.words = Vocabulary(folder)
        about = json.loads(get_bytes(f"{folder}/trie.json"))
        self.span = max(1, self.words.size)
        shards, split = about["shards"], about["split"]
        self.first = np.array([s["u"] * self.span + s["w"] for s in shards], U64)
        self.shard = lru_cache(OPEN_SHARDS)(lambda k: TrieShard(f"{folder}/trie-{shards[k]['k']}"))
        self.split = np.array([s["u"] for s in split], np.int64)
        self.split_bow = np.array([s["bow"] for s in split])

    def look_up(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logp, bow = np.full(len(u), np.nan), np.zeros(len(u))
        keys = u.astype(U64) * U64(self.span) + np.maximum(w, 0).astype(U64)
        shard = np.searchsorted(self.first, keys, side="right") - 1
        for k in np.unique(shard[(shard >= 0) & (u >= 0)]):
            rows = np.flatnonzero((shard == k) & (u >= 0))
            logp[rows], bow[rows] = self.shard(int(k)).look_up(u[rows], w[rows])
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, u), len(self.split) - 1)
            bow = np.where(self.split[at] == u, self.split_bow[at], bow)
        return logp, bow


def train(docs: DataFrame, folder: str, *, least_pair: int = LEAST_PAIR) -> None:
    """Count the learnable documents and write the two levels at ``folder``."""
    texts = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("text").cast("string").alias("text"))
    counts = written(
        texts.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), f"{folder}/counts"
    )
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    rows = sorted(
        counts.repartitionByRange(shards, "h").sortWithinPartitions("h")
        .mapInArrow(_word_writer(folder), "k long, first string, n long, total long").collect()
    )  # one row for each shard
    bases = list(accumulate((r.n for r in rows), initial=0))
    before = list(accumulate((r.total for r in rows), initial=0))
    about = {
        "tokens": before[-1],
        "words": bases[-1],
        "shards": [
            {"k": r.k, "first": r.first, "base": b, "before": n} for r, b, n in zip(rows, bases, before, strict=False)
        ],
    }
    put_file(f"{folder}/words.json", [json.dumps(about).encode()])
    shards = max(1, -(-before[-1] // SHARD_ROWS))
    made = sorted(
        texts.mapInArrow(_pair_counter(folder, SHARD_ROWS), "k int, u long, w long, c long").repartitionById(shards, "k")
        .mapInArrow(
            _trie_writer(folder, least_pair),
            "k long, u long, w long, last long, n long, mass double, last_mass double, last_seen long",
        ).collect()
    )  # one row for each shard
    tries, mass, seen = [], {}, {}
    for i, r in enumerate(made):
        split = i > 0 and made[i - 1].last == r.u
        tries.append({"k": r.k, "u": r.u, "w": r.w if split else 0, "n": r.n})
        if split:
            mass[r.u] = mass.get(r.u, made[i - 1].last_mass) + r.mass
            seen[r.u] = made[i - 1].last_seen
    weights = [{"u": u, "bow": math.log10(max(1 - mass[u] / seen[u], 1e-12))} for u in sorted(mass)]
    put_file(f"{folder}/trie.json", [json.dumps({"shards": tries, "split": weights}).encode()])


_tries: dict[str, Trie] = {}


def _scorer(folder: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _tries:
            _tries.clear()
            _tries[folder] = Trie(folder)
        trie = _tries[folder]
        words = trie.words
        total = words.tokens + words.size + 1
        for part, hashes, sizes in _token_batches(batches):
            distinct, place = np.unique(hashes, return_inverse=True)
            ids, counts = words.find(distinct)
            uniform = np.log10((counts + 1) / total)
            end = int(np.searchsorted(distinct, U64(END)))
            before = np.empty_like(place)
            before[1:] = place[:-1]
            before[np.cumsum(sizes) - sizes] = end
            keys, back = np.unique((before.astype(np.int64) << 32) | place, return_inverse=True)
            u, w = keys >> 32, keys & 0xFFFFFFFF
            order = np.lexsort((ids[w], ids[u]))
            logp, bow = np.empty(len(keys)), np.empty(len(keys))
            logp[order], bow[order] = trie.look_up(ids[u[order]], ids[w[order]])
            logp = np.log10(np.where(np.isnan(logp), 0, 10**logp) + 10 ** (bow + uniform[w]))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes),
                    pa.array(np.bincount(owner, counts[place] > 0, n).astype(np.int64)),
                    pa.array(np.full(n, words.tokens, np.int64)),
                    pa.array(np.bincount(owner, uniform[place], n)),
                    pa.array(np.bincount(owner, logp[back], n)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


def language_model_scores(docs: DataFrame, folder: str | None = None, *, least_pair: int = LEAST_PAIR) -> DataFrame:
    """Train on the learnable documents, then score every document."""
    bounded_batches(docs.sparkSession)
    folder = folder or work_folder(docs.sparkSession, "lm")
    train(docs, folder, least_pair=least_pair)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _scorer(folder),
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
