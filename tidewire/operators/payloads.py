"""Provider answers as typed columns; a malformed answer is null as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scoring as S
from tidewire.functions.topics import normalize_topics

MATCH_CONFIDENCE = 0.8


def json_body(answer: Column) -> Column:
    """The outermost object of an answer, with or without a code fence."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def _parsed(answer: Column, schema: str) -> Column:
    return F.from_json(json_body(answer), schema, {"mode": "PERMISSIVE"})


def prefilter(answer: Column) -> Column:
    """struct(is_ai, confidence): confidence held to 0..1."""
    x = _parsed(answer, "is_ai BOOLEAN, confidence DOUBLE")
    ok = x.is_ai.isNotNull() & x.confidence.isNotNull()
    return F.when(ok, F.struct(x.is_ai.alias("is_ai"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.confidence)).alias("confidence")))


def scoring(answer: Column) -> Column:
    """Dimensions, category, focus, up to five tags and topics; all or nothing."""
    x = _parsed(answer, "ai_focus STRING, impact DOUBLE, novelty DOUBLE, substance DOUBLE, category STRING, focus_category STRING, "
                        "title_zh STRING, one_line_summary STRING, summary_zh STRING, tags ARRAY<STRING>, topic_ids ARRAY<STRING>")
    need = ["ai_focus", "impact", "novelty", "substance", "category", "title_zh", "one_line_summary"]
    ok = F.lit(True)
    for name in need:
        ok = ok & x[name].isNotNull()
    clamp = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(0.0), c))
    text = F.concat_ws(" ", x.title_zh, x.one_line_summary, x.summary_zh)
    return F.when(ok, F.struct(
        x.ai_focus.alias("ai_focus"), *[clamp(x[d]).alias(d) for d in ("impact", "novelty", "substance")], x.category.alias("category"),
        S.resolve_focus(x.focus_category, x.category, text).alias("focus_category"), x.title_zh.alias("title_zh"),
        x.one_line_summary.alias("one_line_summary"), x.summary_zh.alias("summary_zh"),
        F.slice(F.coalesce(x.tags, F.array()), 1, 5).alias("tags"), normalize_topics(x.topic_ids).alias("topic_ids")))


def same_event(answer: Column) -> Column:
    """True only for a strict yes of enough confidence; null if malformed."""
    x = _parsed(answer, "same_event BOOLEAN, confidence DOUBLE")
    ok = x.same_event.isNotNull() & x.confidence.isNotNull()
    return F.when(ok, x.same_event & (x.confidence >= MATCH_CONFIDENCE))


def translation(answer: Column) -> Column:
    """Non-empty paragraphs, or null when one is empty or there is none."""
    x = _parsed(answer, "paragraphs ARRAY<STRING>").paragraphs
    good = (F.size(x) > 0) & F.forall(x, lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda p: F.trim(p)))


def daily_summary(answer: Column) -> Column:
    """Title, body and the notes of known categories."""
    x = _parsed(answer, "title STRING, body STRING, notes MAP<STRING, STRING>")
    ok = (F.trim(x.title) != "") & (F.trim(x.body) != "")
    notes = F.map_filter(F.coalesce(x.notes, F.create_map().cast("map<string,string>")),
                         lambda k, v: k.isin(list(S.FOCUS_LABELS)) & (F.trim(v) != ""))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.trim(x.title).alias("title"), F.trim(x.body).alias("body"), F.map_entries(notes).alias("notes")))


def monthly_trends(answer: Column, roster: Column) -> Column:
    """Trend notes whose cited events are in the roster; uncited ones go."""
    x = _parsed(answer, "trends ARRAY<STRUCT<title: STRING, body: STRING, event_ids: ARRAY<STRING>>>").trends
    cited = F.transform(x, lambda t: F.struct(t.title.alias("title"), t.body.alias("body"),
                                              F.array_intersect(F.coalesce(t.event_ids, F.array()), roster).alias("event_ids")))
    return F.filter(cited, lambda t: F.size(t.event_ids) > 0)


def skip_reason(rows: DataFrame) -> DataFrame:
    """First reason that stops an article: digest, prefilter, body, answer."""
    from tidewire.functions.text import is_digest_title

    reason = (
        F.when(is_digest_title(F.col("title")), F.lit("digest"))
        .when(~F.coalesce(F.col("prefilter.is_ai"), F.lit(True)), F.lit("non_ai"))
        .when(F.trim(F.coalesce("content", F.lit(""))) == "", F.lit("no_content"))
        .when(F.col("scoring").isNull(), F.lit("ai_error"))
    )
    return rows.withColumn("skip_reason", reason)
