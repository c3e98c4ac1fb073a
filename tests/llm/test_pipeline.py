"""The chained stages against slow twins of each."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_classifiers import text  # noqa: E402
from tests.llm.test_duplicates import shingles  # noqa: E402
from tests.llm.test_search_counts_model import brute_contamination  # noqa: E402
from tests.llm.test_token_files_and_mixing import brute_targets  # noqa: E402
from tidewire.llm.common import tokenizer_path  # noqa: E402
from tidewire.llm.language_id import fit  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


def fixture(rng):
    rows = [(i, text(rng, lang := "en de es".split()[i % 3], rng.randrange(20, 60)), lang, f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", rows[i][2], rows[i][3]) for i in range(20)]
    bench = [(f"b{i}", text(rng, "en", 15)) for i in range(3)]
    rows += [(300 + i, text(rng, "en", 30) + " " + bench[i % 3][1], "en", None) for i in range(6)]
    rows += [(400, None, "en", "s0"), (401, "", None, "s1"), (402, "123", None, "s1"), (None, text(rng, "de", 30), None, None), (5, rows[5][1], "es", "s2")]
    return [(*r, len(r[1] or ""), "clash") for r in rows], bench


def written_tables(spark, folder, rows, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_brute_force(rows, bench, model):
    kept = [r for r, out in zip(rows, model.predict([None if r[1] is None else r[1].encode() for r in rows])[2], strict=True) if not out]
    chosen, sets = [], []
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        own = shingles(r[1], 5)
        if not own or not any(100 * len(own & s) >= 80 * len(own | s) for s in sets):
            chosen.append(r)
        sets.append(own)
    return [r for r in chosen if not brute_contamination(r[1], bench)[-1]]


def test_run_equals_the_stages_by_brute_force_and_itself(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, bench = fixture(random.Random(12))
    folder = written_tables(spark, tmp_path, rows, bench)
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) for _ in range(2))
    assert first == second
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = by_brute_force(rows, bench, fit(docs))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(map(tuple, docs.collect())) == Counter(clean)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sums = {r[0]: zlib.crc32(np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in clean}
    copies = Counter(r[0] for r in first)
    assert set(copies) <= set(sums) and all(r[3] == sums[r[0]] for r in first)
    sizes, taken = Counter(), Counter()
    for r in clean:
        n = len(r[1].split())
        sizes[r[3]] += n
        taken[r[3]] += n * copies[r[0]]
        assert copies[r[0]] <= 2
    for source, target in brute_targets(dict(sizes)).items():
        assert taken[source] == pytest.approx(target, rel=0.3)


def test_empty_tables_run(spark, tmp_path):
    assert corpus_pipeline.run(spark, written_tables(spark, tmp_path, [], [])).count() == 0
