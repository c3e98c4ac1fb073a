import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire import api
from tidewire.operators import content, payloads, posts, reports


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "a string").select(column(F.col("a")).alias("x")).first().x


def test_answers_are_all_or_nothing(spark):
    assert one(spark, payloads.same_event, '```json\n{"same_event": true, "confidence": 0.9}\n```') is True
    assert one(spark, payloads.same_event, '{"same_event": true, "confidence": 0.5}') is False
    assert one(spark, payloads.same_event, "no json") is None
    assert one(spark, payloads.prefilter, '{"is_ai": true, "confidence": 7}').confidence == 1.0
    full = '{"ai_focus": "primary", "impact": 12, "novelty": -1, "substance": 5, "category": "research", "title_zh": "t", "one_line_summary": "s", "tags": ["a","b","c","d","e","f"], "topic_ids": ["gpt", "zzz"]}'
    x = one(spark, payloads.scoring, full)
    assert (x.impact, x.novelty, x.substance, x.focus_category, len(x.tags), x.topic_ids) == (10.0, 0.0, 5.0, "technology", 5, ["openai"])
    assert one(spark, payloads.scoring, '{"impact": 3}') is None
    assert one(spark, payloads.translation, '{"paragraphs": ["a", " "]}') is None


def test_blocks():
    html = "<article><h2>Head</h2><p>One <a href='https://x.com/u/status/5'>x</a></p><ul><li>a</li></ul><pre>x  y</pre><script>no</script></article>"
    got = content.blocks_of(content.main_region(html))
    assert [(b["type"], b.get("text")) for b in got] == [("heading", "Head"), ("paragraph", "One x"), ("list_item", "a"), ("code", "x  y")]
    assert content.blocks_of(None) == []


def test_a_page_is_read_to_its_end(spark):
    html = "<article>" + "".join(f"<p>p{i} <a href='https://a.com/{i}'>x</a></p><img src='{i}.png'>" for i in range(1000)) + "</article>"
    got = content.blocks_of(content.main_region(html))
    assert [b.get("text") or b["url"] for b in got] == [x for i in range(1000) for x in (f"p{i} x", f"{i}.png")]
    row = content.extract_content(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row.paragraphs == [f"p{i} x" for i in range(1000)] and row.body == "\n".join(row.paragraphs)
    assert row.links == [f"https://a.com/{i}" for i in range(1000)] and len(json.loads(row.blocks)) == 2000


@pytest.mark.parametrize("inner", ["<article><p>card</p></article>", "<!-- </article> -->", "<!--><i>x</i>", "<script>var t = '</article>';</script>", "<article-card>card</article-card>", "<ARTICLE id=a/>"])
def test_a_region_runs_to_its_own_end(inner):
    text = "word " * 60
    page = f"<p>menu</p><article><p>{text}</p>{inner}<p>after</p></article><p>other</p><!-- end -->"
    for own in (page, page.replace("</article><p>other", "</article ><p>other")):
        said = [b["text"] for b in content.blocks_of(content.main_region(own))]
        assert said[0] == text.strip() and said[-1] == "after"


def test_a_region_without_an_end_of_its_own():
    text = "word " * 60
    assert content.main_region(f"<p>menu</p><article>{text}<article>card</article>after") == f"{text}<article>card</article>after"
    assert content.main_region(f"<p>menu</p><article>{text}") == f"<p>menu</p><article>{text}"


def test_parts_hold_all_pages():
    pages = pd.DataFrame({"page_id": range(7), "html": ["a" * 30, None, "b" * 500, "", "c" * 40, "d" * 70, "e" * 20]})
    found = list(content.parts(pages, "html", 100))
    assert pd.concat(found).equals(pages) and len(found) > 2
    assert all(sum(len(h or "") for h in part.html[1:]) < 100 for part in found)
    assert list(content.parts(pages[:0], "html", 100)) == []


def test_cited_posts(spark):
    pages = spark.createDataFrame([(1, "<p><a href='https://twitter.com/u/status/5'>x</a><a href='https://a.com/b'>y</a></p>"), (2, None)], "page_id long, html string")
    out = content.cited_keys(content.extract_content(pages))
    assert [(r.page_id, r.key) for r in out.collect()] == [(1, "x-status:5")]


def test_parameters_are_checked(spark):
    items = spark.createDataFrame([], "event_id string, published_at timestamp")
    for bad in (dict(days=0), dict(days=91), dict(limit=201), dict(offset=-1), dict(limit=True)):
        with pytest.raises(ValueError):
            api.events(items, today=dt.date(2024, 1, 1), **bad)
    with pytest.raises(ValueError):
        api.period(items, "weekly", "2024-13")


def test_report_ladder():
    assert reports.report_status(items=0, answered=True, attempted=True, complete=True, previous=None) == "empty"
    assert reports.report_status(items=3, answered=True, attempted=True, complete=False, previous=None) == "partial"
    assert reports.report_status(items=3, answered=False, attempted=True, complete=False, previous="generated") == "stale"
    assert reports.report_status(items=3, answered=False, attempted=True, complete=False, previous=None) == "fallback"
    assert ("weekly", "2026-W53") in reports.touched_periods(dt.date(2027, 1, 1), dt.date(2027, 1, 2))


def test_mirror_freezes_eligibility(spark):
    schema = "tweet_id string, author_handle string, created_at timestamp, payload string, pipeline_source_id string"
    now = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("1", "a", now, "old", "x_topics")], schema)
    new = spark.createDataFrame([("1", "a", now, "new", None), ("2", "b", now, "p", "x_accounts"), (None, "c", now, "p", None)], schema)
    got = {r.tweet_id: (r.payload, r.pipeline_source_id) for r in posts.merge_mirror(old, new).collect()}
    assert got == {"1": ("new", "x_topics"), "2": ("p", "x_accounts")}
