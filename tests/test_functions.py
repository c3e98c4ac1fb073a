import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.functions import topics as P
from tidewire.functions.time import day_bounds, period_key, period_range, window_start


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(1).alias("one")])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("url,expected", [
    ("HTTPS://A.com/p/?utm_source=x&b=1&ref=q#f", "https://a.com/p?b=1"),
    ("http://a.com/", "http://a.com/"),
    ("http://a.com/x?b=&a=2", "http://a.com/x?b=&a=2"),
])
def test_canonical_url(spark, url, expected):
    assert value(spark, T.canonical_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize("url,expected", [
    ("https://twitter.com/u/status/12", "x-status:12"),
    ("https://x.com/i/status/12", "x-status:12"),
    ("https://a.com/", None),
    ("https://A.com/p/?spm=1&z=2&b=1", "url:a.com/p?b=1&z=2"),
    ("nonsense", None),
])
def test_reference_key(spark, url, expected):
    assert value(spark, T.reference_key(F.col("u")), u=url) == expected


@pytest.mark.parametrize("title,expected", [
    ("早报｜A/B/C", True), ("快讯｜只有一条", False), ("早报：甲，乙", False), ("IT早报 0818：A；B", True), (None, False),
])
def test_digest_title(spark, title, expected):
    assert value(spark, T.is_digest_title(F.col("t").cast("string")), t=title) is expected


@pytest.mark.parametrize("dims,tier,want_value,want_final", [
    ((7, 6, 7), "T3", 6700, 6700), ((7, 6, 7), "T2", 6700, 7370), ((7, 6, 7), "T1", 6700, 8040),
    ((12, -1, 5), "T3", 5500, 5500), ((10, 10, 10), "T1", 10000, 10000),
])
def test_scores(spark, dims, tier, want_value, want_final):
    v = S.value_hundredths(F.col("i"), F.col("n"), F.col("s"))
    inputs = dict(zip("ins", dims, strict=True), t=tier)
    assert value(spark, v, **inputs) == want_value
    assert value(spark, S.final_hundredths(v, F.col("t")), **inputs) == want_final


def verdict(spark, **over):
    given = dict(focus="primary", source_id="s", impact=5, novelty=5, substance=5, final=5000, category="industry", title="t") | over
    return value(spark, S.selection(**{k: F.col(k) for k in given}), **given)


def test_selection_ladder(spark):
    assert verdict(spark, final=6500).selected
    assert not verdict(spark, final=6499).selected
    assert verdict(spark, final=10000, focus="tangential").bucket == "ai_focus:tangential"
    gate = dict(source_id="arxiv_ai", impact=7, novelty=8, final=9000)
    assert verdict(spark, substance=9, **gate).selected
    assert not verdict(spark, substance=8, **gate).selected
    assert verdict(spark, category="model_release", title="OpenAI 正式发布 GPT-6").bucket == "priority:confirmed_model_release"
    assert not verdict(spark, category="model_release", title="GPT-6 将于下周发布").selected
    assert verdict(spark, category="product_release", title="Claude 额度重置").bucket == "priority:usage_limit_update"


def test_topic_rules(spark):
    text = P.item_text(F.col("t"), F.lit(""), F.array())
    def match(t, ids=None):
        stored = F.lit(None).cast("array<string>") if ids is None else F.array(*[F.lit(i) for i in ids]).cast("array<string>")
        return value(spark, P.matches_topic("meta", stored, text), t=t)

    assert not match("metadata")
    assert match("Meta, again")
    assert not match("Meta", [])
    assert not match("Meta", ["openai"])
    assert value(spark, P.normalize_topics(F.array(F.lit("GPT"), F.lit("nope"), F.lit("openai")))) == ["openai"]


def test_windows():
    assert window_start(dt.datetime(2026, 7, 2, 1), 48) == dt.datetime(2026, 6, 30, 16)
    assert window_start(dt.datetime(2026, 7, 2, 1), 30) == dt.datetime(2026, 6, 30, 19)
    assert day_bounds(dt.date(2026, 7, 1), dt.date(2026, 7, 1)) == (dt.datetime(2026, 6, 30, 16), dt.datetime(2026, 7, 1, 16))
    assert period_range("weekly", "2026-W53") == (dt.date(2026, 12, 28), dt.date(2027, 1, 3))
    assert period_range("monthly", "2024-02") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    with pytest.raises(ValueError):
        period_range("weekly", "2025-W54")


def test_iso_week(spark):
    assert value(spark, period_key("weekly", F.to_date(F.col("d"))), d="2027-01-01") == "2026-W53"


def test_language(spark):
    assert value(spark, T.body_language(F.col("t")), t="中" * 60) == "zh"
    assert value(spark, T.body_language(F.col("t")), t="word " * 60) == "en"
    assert value(spark, T.body_language(F.col("t")), t="short") is None
