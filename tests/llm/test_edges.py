"""Odd rows, clashing columns, and slow twins of the operators that SQL can't express."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_search_counts_model import brute_contamination
from tidewire.llm import language_id as L
from tidewire.llm import toxicity as X
from tidewire.llm.decontamination import clean, contamination
from tidewire.llm.mixing import mixed, mixing_report
from tidewire.llm.near_dedup import near_duplicate_report, parity_sketch, representatives
from tidewire.llm.substring_dedup import Bounds, repeated_units, units_of, without_repeats

WORDS = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize("block", [4_000_000, 25])
def test_clean_beyond_one_block_and_with_clashing_columns(spark, block):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=14))) for i in range(8)]
    docs = [(i, " ".join(rng.choices(WORDS, k=30)) + (" " + items[i % 8][1] if i % 3 == 0 else ""), "r", 1, "k") for i in range(40)] + [(None, None, None, None, None), (7, "", "r", 2, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row string, row int, whole string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = clean(df, bench, block_words=block)
    assert out.columns == df.columns
    want = Counter(d for d in docs if not brute_contamination(d[1], items)[-1])
    assert Counter(map(tuple, out.collect())) == want
    assert clean(df.limit(0), bench, block_words=block).count() == 0
    assert clean(df, bench.limit(0), block_words=block).count() == len(docs)
    assert contamination(df, bench.limit(0)).where("contaminated").isEmpty()


def brute_removed(rows, bounds):
    """Spans that go, by row, when units are taken in order of (id, place)."""
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for place, i in enumerate(order):
        nth = Counter()
        for a, b, kind, line, hi, lo in units_of(rows[i][1] or "", bounds):
            first = seen.setdefault((hi, lo), place)
            if first != place or nth[hi, lo]:
                gone.setdefault(i, []).append((kind, line, a, b))
            nth[hi, lo] += 1
    return {i: [u for u in own if u[0] == 0 or (0, u[1]) not in {(k, n) for k, n, _, _ in own}] for i, own in gone.items()}


@pytest.mark.parametrize("bounds", [{}, {"line": 1, "sentence": 1, "run": 1}])
def test_removed_units_equal_brute_force(spark, bounds):
    rng = random.Random(8)
    pool = [" ".join(rng.choices(WORDS[:40], k=rng.choice([1, 4, 9]))) + rng.choice([".", "!", ""]) for _ in range(25)]
    rows = [(rng.choice([None, i, i % 5]), "".join(rng.choice(pool) + rng.choice([" ", "\n"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (50, None), (51, ""), (52, "long line " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = Counter((rows[i][0], a, b) for i, own in brute_removed(rows, Bounds(**bounds)).items() for _, _, a, b in own)
    assert Counter((r.doc_id, r.start, r.stop) for r in repeated_units(df, **bounds).collect()) == want


def test_without_repeats_replaces_its_own_columns(spark):
    line = "a line of six words here"
    df = spark.createDataFrame([(None, line, "x", 1, 2), (None, line, "y", 1, 2), (None, None, "z", 1, 2)], "doc_id long, text string, clean_text string, removed_spans int, row int")
    out = without_repeats(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted(str(r.clean_text) for r in out.collect()) == ["", "None", line]
    assert without_repeats(df.limit(0)).count() == 0


def test_representatives_with_clashing_columns_and_null_ids(spark):
    text = " ".join(WORDS[:40])
    rows = [(None, text, 1, "d", "h", "g"), (None, text + " tail", 2, "d", "h", "g"), (4, "q " * 9, 3, "d", "h", "g"), (4, "q " * 9, 4, "d", "h", "g"), (5, " \t", 5, "d", "h", "g"), (5, None, 6, "d", "h", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own int, _doc string, _hash string, _digest string")
    out = representatives(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r._own for r in got if r.doc_id == 5) == [5, 6]
    assert len([r for r in got if r.doc_id is None]) == 1 and len([r for r in got if r.doc_id == 4]) == 1
    assert all((r._doc, r._hash, r._digest) == ("d", "h", "g") for r in got)
    mixed_ids = near_duplicate_report(df.where("doc_id is null or doc_id = 4")).collect()
    assert sorted(str(r.component_id) for r in mixed_ids) == ["4", "4", "None", "None"]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.concatenate([a[: rng.integers(1, 300)], rng.integers(0, 2**63, rng.integers(0, 80)).astype(np.uint64)])
        differ = int(np.bitwise_count((parity_sketch(a) ^ parity_sketch(np.unique(b))).view(np.uint64)).sum())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_hub_rounds_lose_no_link_of_a_large_near_copy_group(spark):
    from tests.llm.test_duplicates import brute_components, edited

    rng = random.Random(6)
    base = rng.choices(WORDS, k=80)
    rows = [(i, " ".join(edited(rng, base, 0.025))) for i in range(220)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_draws_of_null_and_repeated_ids_stand_alone(spark):
    rows = [(None, "a", f"word {i}") for i in range(1500)] + [(7, "b", "same text") for _ in range(1500)] + [(i, "c", "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    once = mixing_report(df)
    sums = once.join(df.select("doc_id", "source").distinct(), df.doc_id.eqNullSafe(once.doc_id)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    taken = {r.source: (r.t, r.g) for r in once.withColumn("source", F.when(F.col("doc_id").isNull(), "a").otherwise("b")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect() if r.source == "a"}
    assert sums.count() == 3 and all(abs(t - g) < 0.1 * g for t, g in taken.values())
    b = once.where("doc_id = 7 and size = 2").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert abs(b.t - b.g) < 0.1 * b.g
    assert mixed(df).count() == once.agg(F.sum("copies")).first()[0]


def test_equal_ratios_share_alike(spark):
    rows = [(i, s, "w " * 10) for i, s in enumerate("abcdef" * 20)] + [(900, "a", "w " * 100_000)]
    got = mixing_report(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert got.where("target > 2 * source_size").isEmpty() and got.where("doc_id = 900").first().size == 100_000


def test_letters():
    assert not any(L.has_letter(t.encode()) for t in ("½", "²³", "Ⅷ", "12 !_", ""))
    assert all(L.has_letter(t.encode()) for t in ("ª", "ß", "中", "1a"))


def slow_vector(text, idf):
    """TF-IDF of byte n-grams in plain Python."""
    framed = L.letters(text)
    tf = Counter()
    for n in range(1, L.LONGEST + 1):
        for i in range(len(framed) - n + 1):
            h = 0
            for b in framed[i : i + n]:
                h = (h * int(L.MULT) + b) % 2**64
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            tf[(h ^ (h >> 27)) >> (64 - L.DIM_BITS)] += 1
    weights = {s: math.log1p(c) * float(idf[s]) for s, c in tf.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {s: w / norm for s, w in weights.items()}


def test_language_scores_equal_explicit_cosines(spark):
    from tests.llm.test_classifiers import text

    rng = random.Random(3)
    rows = [(i, text(rng, lang := "en de es".split()[i % 3], 30), lang) for i in range(150)] + [(1, None, "en"), (1, "same row", ""), (1, "same row", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert set(model.languages) >= {"en", "de", "es"}
    texts = [t for _, t, _ in rows[:20]] + ["über ction", "a"]
    langs, scores, _ = model.predict([t.encode() for t in texts])
    for t, lang, score in zip(texts, langs, scores, strict=True):
        own = slow_vector(t.encode(), model.idf)
        cosines = [sum(w * float(c[s]) for s, w in own.items()) for c in model.centres]
        assert score == pytest.approx(max(cosines), abs=1e-4)
        assert lang == model.languages[model.owners[int(np.argmax(cosines))]]


def test_unseen_scripts_and_junk_are_rejected(spark):
    from tests.llm.test_classifiers import text

    rng = random.Random(4)
    df = spark.createDataFrame([(i, text(rng, lang := "en de es".split()[i % 3], 60), lang) for i in range(300)], "doc_id long, text string, lang string")
    model = L.fit(df)
    odd = ["Все люди рождаются свободными и равными в своем достоинстве", "すべての人間は生まれながらにして自由であり", "xkqzv bqrtw pqzzk wvxkj qqzrk kkzpw xvbqq"]
    own = [text(rng, lang, n) for lang in ("en", "de", "es") for n in (2, 8, 40, 900)]
    assert model.predict([t.encode() for t in odd])[2].all()
    assert not model.predict([t.encode() for t in own])[2].any()


def test_toxic_scores_equal_explicit_means():
    rng = np.random.default_rng(1)
    table = rng.normal(size=1 << X.BUCKET_BITS)
    texts = [b"Plain words, and (marks)!", b"a", "Ünïcode wörds ß".encode(), b"again again " * 400, None, b"  "]
    got = X.Scorer(table, 0.25)(texts)
    for text, score in zip(texts, got, strict=True):
        values = []
        for word in (text or b"").lower().split():
            framed = b"<" + word.strip(X._MARKS) + b">"
            for n in X.LENGTHS:
                for i in range(len(framed) - n + 1):
                    h = 0
                    for b in framed[i : i + n]:
                        h = (h * int(X.MULT) + b + 1) % 2**64
                    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
                    values.append(table[(h ^ (h >> 27)) >> (64 - X.BUCKET_BITS)])
        logit = (sum(values) / len(values) if values else 0) + 0.25
        assert score == pytest.approx(1 / (1 + math.exp(-logit)))


def test_toxicity_on_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "long " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert X.training_rows(docs, labels).count() == len({r.doc_id for r in X.training_rows(docs, labels).collect()})
    out = X.toxicity_scores(docs, labels)
    assert out.count() == 4 and out.where("score < 0 or score > 1 or score is null").isEmpty()
    assert X.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0
