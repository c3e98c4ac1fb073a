import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import hamming_search as H
from tidewire.llm.decontamination import clean, contamination, items_digest, winnow
from tidewire.llm.elias_fano import EliasFano, flat
from tidewire.llm.language_model import language_model_scores
from tidewire.llm.queries import op8_language_model
from tidewire.llm.textkernel import word_hashes
from tidewire.llm.token_rollup import TokenRollup, image, inserts, rollup_history


def brute_top(rows, queries, k):
    out = []
    for q, c in queries:
        near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in set(rows) if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0, 3])
def test_top_k_is_exact(spark, spread):
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(400):
        c = rng.getrandbits(64) if spread == 0 and i % 2 else centres[i % 5]
        for _ in range(rng.randrange(spread + 1)):
            c ^= 1 << rng.randrange(64)
        rows.append((i, c - 2**64 if c >= 2**63 else c))
    df = spark.createDataFrame(rows + rows[:3] + [(999, None)], "id long, code long")
    asked = [r for r in rows if r[0] % 50 == 0]
    got = H.top_k(df, df.where("id % 50 = 0"), k=10)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, asked, 10)


def test_unfit_vectors_have_no_code(spark):
    bad = [(0, [1.0] * 64), (50, [1.0] * 63), (100, None), (150, [float("nan")] * 64), (1, [-1.0] * 64)]
    out = H.embedding_search(spark.createDataFrame(bad, "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.vec_id, r.distance) for r in out.collect()] == [(0, 1, 64)]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for top, n in ((50, 40), (10**12, 500), (3, 300), (1, 1)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano.open(flat("x", EliasFano.encode(values)), "x")
        assert np.array_equal(ef[np.arange(n)], values)
        probe = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 5, 50).astype(np.uint64)])
        assert np.array_equal(ef.successors(probe), np.searchsorted(values, probe))


def test_language_model_against_counts(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5000)]
    rows = [(i, " ".join(words[i * 16 : i * 16 + rng.randrange(16)])) for i in range(300)] + [(400, None), (401, "never-seen W1\tw2"), (402, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model_scores(df, least_pair=2).collect()}
    tokens = {i: [*(t or "").lower().split(), "\n"] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(["\n", *tokens[i]], tokens[i], strict=False))
    kept = {p: c for p, c in pairs.items() if c >= 2}
    n, v = sum(uni.values()), len(uni)
    left = {u: 1 - sum(c - 0.75 for (a, _), c in kept.items() if a == u) / uni[u] for u in uni}
    base = lambda w: (uni[w] + 1) / (n + v + 1)
    prob = lambda u, w: (kept[u, w] - 0.75) / uni[u] + left[u] * base(w) if (u, w) in kept else left.get(u, 1) * base(w)
    for i, own in tokens.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in uni for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10(base(w)) for w in own))
        exact = sum(math.log10(prob(u, w)) for u, w in zip(["\n", *own], own, strict=False))
        assert r.score == pytest.approx(exact, abs=0.03 * len(own))


@pytest.mark.parametrize("shard_rows", [2_000_000, 97])
def test_query_keeps_pairs_seen_once(spark, tmp_path, monkeypatch, shard_rows):
    monkeypatch.setattr("tidewire.llm.language_model.SHARD_ROWS", shard_rows)
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(16)))) for i in range(300)] + [(400, None), (401, "never-seen w2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_language_model(spark, str(tmp_path)).collect()}
    tokens = {i: [*(t or "").split(), "\n"] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(["\n", *tokens[i]], tokens[i], strict=False))
    degree, whole = Counter(u for u, _ in pairs), sum(uni.values()) + len(uni) + 1
    base = lambda w: (uni[w] + 1) / whole
    prob = lambda u, w: max(pairs[u, w] - 0.75, 0) / uni[u] + 0.75 * degree[u] / uni[u] * base(w) if u in uni else base(w)
    assert sum(c == 1 for c in pairs.values()) > 400
    for i, own in tokens.items():
        exact = sum(math.log10(prob(u, w)) for u, w in zip(["\n", *own], own, strict=False))
        assert got[i].score == pytest.approx(exact, abs=0.05 * len(own))


def test_language_model_without_rows(spark):
    assert language_model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_contamination(text, items):
    words = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in (t if t else "")).translate({i: " " for i in range(128) if not chr(i).isalnum()}).split(" ") if w]
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(10, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for b in range(len(doc) - n + 1):
                if doc[b : b + n] == own[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(str(name))
    return len(doc), len(hit), len(found), items_digest(sorted(found)), bool(hit)


@pytest.mark.parametrize("block", [4_000_000, 25])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(3)
    pool = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(pool, k=k))) for i, k in enumerate([30, 12, 10, 9, 4, 1, 40])] + [(7, ""), (8, None), (9, "same same " * 15), (2, "dup id words")]
    items.append((10, items[0][1]))
    docs = [(0, None), (1, ""), (2, "same " * 60), (3, ", ".join(items[0][1].upper().split()[3:20])), (4, items[3][1]), (5, "x-" + items[2][1] + "-y")]
    docs += [(i, " ".join(rng.choices(pool, k=40)) + " " + " ".join(items[i % 7][1].split()[:11])) for i in range(6, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    out = contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert got == {i: brute_contamination(t, items) for i, t in docs}
    kept = clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r[-1]}


def test_every_span_of_ten_words_has_a_fingerprint():
    rng = random.Random(1)
    for _ in range(30):
        hashes = word_hashes([rng.choice([b"a", b"b", b"c"]) for _ in range(40)])
        kept = set(winnow(hashes).tolist())
        assert all(kept & set(range(s, s + 6)) for s in range(31))


def test_rollup_batches_commit_once(spark, tmp_path):
    store = TokenRollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, None, None)], "source string, lang string, n int")
    rows = inserts(image(df, "t1", F.col("n")))
    assert store.commit("one", rows) and not store.commit("one", rows)
    assert store.commit("none", rows.limit(0))
    assert sorted(tuple(r) for r in store.totals().collect() if r.source) == [("a", "en", "t1", 2, 7)]
    assert store.log.append(0, {"batch": "late", "state": "x"}) is False


def test_rollup_history_on_odd_rows(spark):
    rows = [(1, "s", "en", "a b"), (2, "s", "en", "a b"), (3, None, None, None), (4, "s", "de", ""), (5, "s", "de", "x, y")]
    out = rollup_history(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"))
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    assert got == sorted(map(str, [("s", "en", "words-1", 1, 2), (None, None, "pieces-2", 1, 0), ("s", "de", "pieces-2", 2, 3)]))
