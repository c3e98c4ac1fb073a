import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.common import tokenizer_path
from tidewire.llm.mixing import mixed, mixing_report, source_targets
from tidewire.llm.storage import work_folder
from tidewire.llm.token_files import document_ids, encoder_for, read_token_digests, token_id_output, write_token_files

TEXTS = ["Hello, wörld!  It's fine. ÀÉ ß", "", None, "éte <|endoftext|>x 12 ½ 中文\x1cz", "the the\n\x0bidiot " * 3000, "Ünïcode İstanbul Σας"]


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_encode_like_the_whole_text(reference_ids):
    encoder = encoder_for(tokenizer_path())
    for text in TEXTS:
        ids = np.frombuffer(encoder.encode((text or "").encode()), encoder.dtype).tolist()
        assert [*ids, 1] == reference_ids(text)


def test_round_trip(spark, reference_ids):
    rows = [(i * 3 % 7, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    folder = work_folder(spark, "test-tokens")
    manifest = write_token_files(df, folder, tokenizer_path())
    got = sorted(read_token_digests(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    at = 0
    for n, r in enumerate(got):
        ids = document_ids(folder, n)
        assert r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        assert ids.tolist() in [reference_ids(t) for d, t in rows if d == r.doc_id]
        at += len(ids)
    assert manifest["n_tokens"] == at


def test_empty_table_makes_an_empty_store(spark):
    assert token_id_output(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def brute_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [n for n in names if n not in fixed]
        level = left / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if level * weight[n] > cap * sizes[n]]
        if not over:
            return fixed | {n: level * weight[n] for n in free}
        fixed |= {n: cap * sizes[n] for n in over}


def test_targets_are_the_water_level(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, "é": 70, None: 300}
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source])


def test_mix_is_the_same_again_and_near_its_targets(spark):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", "w " * (1 + i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    once, again = mixing_report(df), mixing_report(df.repartition(7))
    assert sorted(once.collect()) == sorted(again.collect())
    assert once.where("taken > 2 * size").isEmpty()
    sums = once.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert all(abs(r.t - r.g) < 0.1 * r.g for r in sums.collect())


def test_mixed_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a", "x y", 5, "k"), (2, None, None, 6, "l"), (1, "a", "x y", 5, "k")], "doc_id long, source string, text string, size int, copies string")
    out = mixed(df)
    assert out.columns == df.columns
    counts = mixing_report(df).select("copies").collect()
    assert out.count() == sum(r.copies for r in counts)
    assert mixed(df.limit(0)).count() == 0


def test_salted_join_gives_the_same_mix(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 4}", "w " * i) for i in range(50)], "doc_id long, source string, text string")
    want = sorted(mixing_report(df).collect())
    monkeypatch.setattr("tidewire.llm.mixing.BROADCAST_SOURCES", 0)
    assert sorted(mixing_report(df).collect()) == want
