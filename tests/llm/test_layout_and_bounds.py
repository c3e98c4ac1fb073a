"""Results that hold for any layout, and bounds on what is fitted."""

import pytest

from tidewire.llm import common
from tidewire.llm.language_id import language_ids
from tidewire.llm.mixing import mixed, mixing_report

SCHEMA = "doc_id long, text string, source string, n_chars int"

def test_repeated_rows_are_mixed_alike_in_any_layout(spark):
    rows = [(7, "one two three", "a", 1)] * 400 + [(None, None, None, 1)] * 30 + [(100 + i, f"w{i} x", "b", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [sorted((tuple(r) for r in mixing_report(docs.repartition(n)).collect()), key=repr) for n in (2, 3, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    own = [r for r in found[0] if r[0] == 7]
    taken = sum(r[4] for r in own)
    assert abs(taken - own[0][3]) <= 0.1 * own[0][3] and len({r[5] for r in own}) == 2  # draws of their own

def test_rows_that_differ_elsewhere_stay_whole_in_the_mix(spark):
    rows = [(7, "one two", "a", n % 3) for n in range(60)] + [(8, "x", "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted((tuple(r) for r in mixed(docs.repartition(n)).collect()), key=repr) for n in (2, 4)]
    assert runs[0] == runs[1] and {r[3] for r in runs[0] if r[0] == 7} == {0, 1, 2}

def test_sample_of_the_largest_keys(spark):
    rows = [(k, i) for k, n in (("a", 9), ("b", 5), ("c", 5), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, tag long")
    found = common.bounded_sample(df, "key", "tag", 3, most_keys=2).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in found} == {"a": 3, "b": 3}

def test_many_languages_do_not_end_the_run(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_KEYS", 3)
    monkeypatch.setattr(common.bounded_sample, "__kwdefaults__", {"most_keys": 3})
    words = {"en": "the and of with which", "de": "und der die das nicht", "fr": "les des est dans pour"}
    rows = [(i, words[x] + f" {words[x][::-1]} {i}", x) for i, x in enumerate(list(words) * 20)] + [(1000 + i, f"zz{i} qq", f"l{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_ids(docs).collect()}
    assert len(found) == len(rows) and set(found.values()) <= set(words)
    assert sum(found[i] == x for i, x in enumerate(list(words) * 20)) >= 57

def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing_report(docs).collect() == [] and mixed(docs).collect() == []

