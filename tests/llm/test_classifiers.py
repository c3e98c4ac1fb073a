import random
import zlib

import pytest

from tidewire.llm.language_id import accepted, language_ids
from tidewire.llm.toxicity import toxicity_scores, train

SYLLABLES = {"en": ["the", "ing", "tion", "and", "er"], "de": ["sch", "ung", "ein", "keit", "ü"], "es": ["ción", "ado", "que", "ñ", "os"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(n))


def test_languages_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, l := "en de es".split()[i % 3]), l) for i in range(240)]
    odd = [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (903, text(rng, "de", 15000), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' as score")
    got = {r.doc_id: r for r in language_ids(df).collect()}
    assert len(got) == 244
    held = [(i, l) for i, _, l in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out and got[i].lang_pred == l for i, l in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, _ in rows}
    assert kept.where("doc_id in (900, 901, 902)").isEmpty()


def test_nothing_to_learn_is_und(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_ids(df).collect()] == ["und"]
    assert language_ids(df.limit(0)).count() == 0


def test_misspelt_insults_share_ngrams(spark):
    rng = random.Random(2)
    bad = ["idiotic", "idiots", "idiotlike", "moronic", "morons", "moronish"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = text(rng, "en", 60).split()
        if toxic:
            words[5] = words[30] = words[50] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, text(rng, "en", 30) + " idiotize moronify " + text(rng, "en", 30)), (1001, None), (1002, ""), (1003, text(rng, "en"))]
    out = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == (i % 4 == 0) for i in held)
    assert all(got[i].held_out for i in held) and right >= 0.9 * len(held)
    assert got[1000].score > got[1003].score
    assert 0 <= got[1001].score <= 1 and got[1001].score == got[1002].score


def test_one_class_gives_its_share():
    _, bias = train([b"a", b"b"], [0, 0])
    assert bias == pytest.approx(-4.595, abs=0.01)
