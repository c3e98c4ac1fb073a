import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewire.llm import near_dedup
from tidewire.llm.near_dedup import near_duplicate_report, representatives, table_side
from tidewire.llm.substring_dedup import repeated_units, without_repeats

VOCABULARY = [f"w{i}" for i in range(4000)]


def shingles(text, n=3):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_components(rows, percent=85, n=3):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three"), (6, "one")]
    for g in range(12):
        base = rng.choices(VOCABULARY, k=rng.choice([12, 60, 200]))
        for _ in range(rng.choice([1, 4, 25])):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))))
    passage = rng.choices(VOCABULARY, k=60)
    rows += [(len(rows) + i, " ".join(rng.choices(VOCABULARY, k=25) + passage)) for i in range(20)]
    rows.append((len(rows), " ".join(rng.choices(VOCABULARY, k=20000))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_report(df).collect())
    assert got == brute_components(rows)


def test_representatives_keep_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, "z"), (4, "", "z"), (5, "q r s t u v", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = representatives(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]
    assert representatives(df.limit(0)).count() == 0


def test_table_side_holds_the_chance_of_a_miss():
    for t in (0.8, 0.85):
        m = table_side(t)
        assert 2 * (1 - t * t) ** m <= 1e-4 and m * m > 2 * m * 2


LINE = "this very long line is repeated in many documents."
PASSAGE = "Eins zwei drei vier fünf sechs sieben acht neun. Alpha beta gamma delta epsilon zeta eta theta iota kappa. Tail of it"


def test_repeated_units_keep_the_first(spark):
    rows = [
        (3, f"Own words here, quite unlike others.\n{LINE}\nshort line"), (1, f"{LINE}\nshort line"), (2, f"Start of mine {PASSAGE} and end of mine."),
        (5, f"Other start {PASSAGE} other end"), (7, f"{LINE.upper()}\nand {LINE}\n{LINE}"), (8, None), (9, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    texts = dict(rows)
    got = sorted((r.doc_id, texts[r.doc_id][r.start : r.stop], r.unit, r.first_doc_id) for r in repeated_units(df.select("doc_id", "text")).collect())
    assert got == [
        (3, LINE, "line", 1),
        (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "sentence", 2),
        (7, LINE.upper(), "line", 1), (7, LINE, "line", 1),
    ]
    clean = {r.doc_id: r.clean_text for r in without_repeats(df.select("doc_id", "text")).collect()}
    assert clean[1] == texts[1] and clean[3] == "Own words here, quite unlike others.\n\nshort line" and clean[8] is None
    assert repeated_units(df.limit(0)).count() == 0


SHORT = ["Sit down now.", "We wait here!", "Who is that?", "Nobody knows it.", "Close the door.", "It is late.", "Go to sleep.", "See you soon."]
HAN = "今天的天气非常好我们一起去公园散步吧"


def test_short_sentences_lines_and_unspaced_scripts_are_found(spark):
    sentence = "One sentence that stands alone on its line here."
    passage, lines = " ".join(SHORT), "\n".join(SHORT)
    rows = [
        (1, f"Alpha. {passage} Omega."), (2, f"Beta begins. {passage} Another end."), (3, f"Gamma.\n{lines}\nLast."),
        (4, sentence), (5, f"Before it came this. {sentence} And this after it."),
        (6, f"一。{HAN}。二。"), (7, f"三\n{HAN}。\n四"), (8, HAN * 3), (9, f"五\n{HAN * 3}"), (10, " ".join(SHORT[:3])), (11, " ".join(SHORT[:3])),
    ]
    got = {r.doc_id: r.clean_text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(got[i] == texts[i] for i in (1, 4, 6, 8, 10))
    assert got[2].split() == "Beta begins. Another end.".split() and got[3].split() == ["Gamma.", "Last."]
    assert got[5].split() == "Before it came this. And this after it.".split()
    assert got[7].split() == ["三", "四"] and got[9].split() == ["五"] and got[11] == ""


def test_first_occurrence_of_every_sentence_stays(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choices(VOCABULARY, k=rng.choice([1, 2, 3, 5, 9, 20]))) + "." for _ in range(60)]
    rows = []
    for i in range(80):
        a, own = rng.randrange(50), [f"Own{i} {j}." for j in range(6)]
        block = pool[a : a + rng.randrange(2, 12)]
        parts = own[:3] + block + own[3:]
        rows.append((i, "".join(p + rng.choice([" ", "\n"]) for p in parts), block))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in without_repeats(df).collect()}
    left = " ".join(" ".join(got[i].split()) for i, _, _ in rows)
    assert all(s in left for _, _, block in rows for s in block)
    for i, _, block in rows:
        assert all(f"Own{i} {j}." in got[i] for j in range(6))
        for _, _, other in rows[:i]:
            shared = [s for s in block if s in other]
            if sum(len(s.split()) for s in shared) >= 16:
                assert not any(f" {s} " in f" {' '.join(got[i].split())} " for s in shared)


def test_row_functions_give_each_row_of_a_long_batch_once(tmp_path):
    n = 5 * near_dedup.SLICE_ROWS + 7
    ids = pa.array(range(n), pa.int64())
    texts = pa.array([f"a b c d{i} e f g" for i in range(n)])
    signed = near_dedup._signer(3, 4)(iter([pa.record_batch([ids, ids, texts], ["doc_id", "text_hash", "text"])]))
    assert [i for part in signed for i in part.column(0).to_pylist()] == list(range(n))
    linked = near_dedup._linker(3, 85)(iter([pa.record_batch([ids, ids, texts, texts], ["src", "dst", "src_text", "dst_text"])]))
    assert [i for part in linked for i in part.column(1).to_pylist()] == list(range(n))
    np.zeros(1 << near_dedup.ORDER_BITS, "<i4").tofile(tmp_path / "rarity")
    rows = near_dedup._prefixer(3, 85, str(tmp_path / "rarity"))(iter([pa.record_batch([ids, ids, ids, texts], ["node", "n", "comp", "text"])]))
    own = [i for part in rows for i in part.column(0).to_pylist()]
    assert sorted(set(own)) == list(range(n)) and len(own) == n * (own.count(0))


def test_report_has_one_row_for_each_of_many_in_a_partition(spark):
    rows = [(i, f"a{i % 150} b{i % 150} c{i % 150} d e f") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_report(df).collect())
    assert got == brute_components(rows)
