"""Queries over the bound tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.functions import topics as P
from tidewire.functions.time import day_bounds, local_day, period_key, window_start
from tidewire.functions.vector import cosine, norm
from tidewire.operators import cluster, graph, ledger, normalize, rank, recall, upsert, views
from tidewire.plans import bindings as B
from tidewire.session import checkpoint_folder, checkpointed, table
from tidewire.sources import feeds
from tidewire.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW = datetime(2024, 1, 30, 12, 0)
DAY = "CAST(timezone('Asia/Shanghai', timezone('UTC', {})) AS DATE)"


def query(name: str, sql: str | None = None, *, bound: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (B.SQL if bound else "") + sql
        return f

    return add


# --- hotspots and windows -------------------------------------------------

HOT_START = window_start(NOW, 48)


@query("hotspots", f"""
SELECT event_id, count(DISTINCT article_id) AS window_report_count, count(DISTINCT source_key) AS window_source_count,
       max(score_cents) AS final_score
FROM reports WHERE ts >= TIMESTAMP '{HOT_START}' AND ts <= TIMESTAMP '{NOW}' GROUP BY event_id
ORDER BY count(DISTINCT source_key) >= 2 DESC, window_report_count DESC, window_source_count DESC, final_score DESC,
         max(ts) DESC, event_id LIMIT 5""")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    inside = B.reports(spark, sf).where(F.col("ts").between(F.lit(HOT_START), F.lit(NOW)))
    facts = inside.groupBy("event_id").agg(F.max("score_cents").alias("final_score"), F.max("ts").alias("last_seen_at"))
    counts = views.window_coverage(inside, HOT_START, NOW)
    return views.hotspot_board(counts.join(facts, "event_id")).drop("last_seen_at")


@query("window_coverage", f"""
SELECT r.event_id, count(DISTINCT w.article_id) AS window_report_count, count(DISTINCT w.source_key) AS window_source_count
FROM (SELECT DISTINCT event_id FROM reports) r
LEFT JOIN (SELECT * FROM reports WHERE ts >= TIMESTAMP '{HOT_START}' AND ts <= TIMESTAMP '{NOW}') w ON r.event_id = w.event_id
GROUP BY r.event_id""")
def window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf)
    return views.window_coverage(rows, HOT_START, NOW, ids=rows.select("event_id"))


@query("recent_days_filter", f"""
SELECT a.id FROM articles a JOIN sources s ON s.id = a.source_id
WHERE s.days = 0 OR {DAY.format('published_at')} BETWEEN DATE '2024-01-20' - (s.days - 1) AND DATE '2024-01-20'""")
def recent_days_filter(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.within_recent_days(B.articles(spark, sf), B.sources(spark, sf), date(2024, 1, 20)).select("id")


@query("calendar_windows", f"""
SELECT strftime({DAY.format('ts')}, '%Y-%m-%d') AS day, event_id, count(*) AS reports, count(DISTINCT source_key) AS sources FROM reports GROUP BY ALL""")
def calendar_windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.reports(spark, sf).groupBy(local_day(F.col("ts")).cast("string").alias("day"), "event_id").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("source_key").alias("sources"))


@query("period_keys", f"""
SELECT strftime({DAY.format('ts')}, '%G-W%V') AS week_key, strftime({DAY.format('ts')}, '%Y-%m') AS month_key, count(*) AS n
FROM reports GROUP BY ALL""")
def period_keys(spark: SparkSession, sf: str) -> DataFrame:
    day = local_day(F.col("ts"))
    return B.reports(spark, sf).groupBy(period_key("weekly", day).alias("week_key"), period_key("monthly", day).alias("month_key")).agg(
        F.count(F.lit(1)).alias("n"))


# --- normalisation --------------------------------------------------------

@query("canonical_url", r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
  lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') ||
  CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
FROM (SELECT page_id, trim(url) AS url, array_to_string(list_transform(list_filter(list_transform(
   list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> ''),
   lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' ')) ELSE '' END]),
   lambda x: NOT starts_with(lower(x[1]), 'utm_') AND lower(x[1]) NOT IN ('fbclid', 'gclid', 'igshid', 'mc_cid', 'mc_eid', 'ref')),
   lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') AS q
  FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'q=%7Ea+b%2F*&UTM%5Fx=1&e' ELSE '' END AS url FROM pages))""", bound=False)
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    more = F.concat(F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("q=%7Ea+b%2F*&UTM%5Fx=1&e"))
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, more).otherwise(F.lit("")))
    return table(spark, sf, "pages").select("page_id", T.canonical_url(url).alias("canonical"))


@query("reference_keys")
def reference_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.reference_key(F.col("url")).alias("reference_key"))


@query("stable_hash", "SELECT id, sha256(content) AS content_hash, substr(sha256(content), 1, 16) AS short_hash FROM articles")
def stable_hash(spark: SparkSession, sf: str) -> DataFrame:
    return B.articles(spark, sf).select("id", T.stable_hash(F.col("content")).alias("content_hash"), T.short_hash(F.col("content")).alias("short_hash"))


@query("article_identity", r"""
SELECT page_id, sha256(url) AS url_hash, sha256(lower(title)) AS title_hash, substr(sha256('feed:' || sha256(url)), 1, 24) AS article_id
FROM (SELECT page_id, 'https://site.example/p/' || page_id AS url, trim(regexp_replace('Page  ' || page_id || ' ', '\s+', ' ', 'g')) AS title FROM pages)""", bound=False)
def article_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(
        "page_id", F.lit("feed").alias("source_id"), F.concat(F.lit("HTTPS://Site.Example/p/"), "page_id", F.lit("/?utm_source=x#top")).alias("source_url"),
        F.concat(F.lit("Page  "), "page_id", F.lit(" ")).alias("title"), F.col("html").alias("content"), F.lit(None).cast("timestamp").alias("published_at"))
    done = normalize.normalize_articles(rows, now="2024-01-01 00:00:00")
    return done.select("page_id", "url_hash", "title_hash", F.col("id").alias("article_id"))


@query("strip_html", r"""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'),
  '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))) AS text_hash FROM pages""", bound=False)
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.stable_hash(T.strip_html(F.col("html"))).alias("text_hash"))


@query("page_titles")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", feeds.page_title(F.col("html")).alias("title"), feeds.page_description(F.col("html")).alias("description"))


@query("body_language", r"""
SELECT id, CASE WHEN c >= 50 OR (c > 0 AND c * 4 >= l) THEN 'zh' WHEN l >= 200 AND c < 10 THEN 'en' END AS detected FROM (
  SELECT id, len(regexp_extract_all(content, '[\x{4E00}-\x{9FFF}]')) AS c, len(regexp_extract_all(content, '[A-Za-z]')) AS l FROM articles)""")
def body_language(spark: SparkSession, sf: str) -> DataFrame:
    return B.articles(spark, sf).select("id", T.body_language(F.col("content")).alias("detected"))


TITLES = "CASE id % 4 WHEN 0 THEN '早报｜' || title || '/' || source_id WHEN 1 THEN '快讯｜' || replace(title, ';', ' ') WHEN 2 THEN 'IT早报 0818：A；B' ELSE title END"


@query("digest_titles", rf"""
SELECT id, regexp_matches(t, '^[^：:｜|]{{0,4}}(早报|晚报|午报|日报|周报|快讯|简讯|速览|要闻)\s*[0-9]{{0,6}}\s*[｜|：:]\s*(.+)$')
  AND len(list_filter(string_split_regex(regexp_extract(t, '^[^：:｜|]{{0,4}}(早报|晚报|午报|日报|周报|快讯|简讯|速览|要闻)\s*[0-9]{{0,6}}\s*[｜|：:]\s*(.+)$', 2), '[/／；;、]'), lambda x: trim(x) <> '')) >= 2 AS is_digest
FROM (SELECT id, trim({TITLES}) AS t FROM articles)""")
def digest_titles(spark: SparkSession, sf: str) -> DataFrame:
    return B.articles(spark, sf).select("id", T.is_digest_title(F.expr(TITLES)).alias("is_digest"))


@query("dedupe_single_key", "SELECT min(id) AS id FROM articles GROUP BY sha256(content)")
def dedupe_single_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.articles(spark, sf).select("id", T.stable_hash(F.col("content")).alias("key"))
    return rows.groupBy("key").agg(F.min("id").alias("id")).select("id")


@query("dedupe_two_key")
def dedupe_two_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.articles(spark, sf).select("id", T.stable_hash(F.col("content")).alias("url_hash"), T.stable_hash(F.lower("title")).alias("title_hash"))
    return normalize.dedupe_two_keys(rows, url="url_hash", title="title_hash", order="id").select("id")


@query("text_budget", """
SELECT conv_id, turn, length(substr(text, 1, CAST(greatest(0, 2000 - used) AS INTEGER))) AS kept_chars FROM (
  SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM conversations) WHERE used < 2000""", bound=False)
def text_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.chunk_paragraphs(table(spark, sf, "conversations"), key="conv_id", order="turn", body="text", budget=2000)
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("kept_chars"))


# --- scores, selection, taxonomy, topics ----------------------------------

@query("scores", """
SELECT id, v AS value_hundredths, least(10000, CAST(floor(v * CASE tier WHEN 'T1' THEN 12 WHEN 'T2' THEN 11 ELSE 10 END / 10.0 + 0.5) AS BIGINT)) AS final_hundredths
FROM (SELECT id, tier, CAST(100 * (least(impact, 10) * 4 + least(novelty, 10) * 3 + least(substance, 10) * 3) AS BIGINT) AS v FROM scored)""")
def scores(spark: SparkSession, sf: str) -> DataFrame:
    value = S.value_hundredths(F.col("impact"), F.col("novelty"), F.col("substance"))
    return B.scored(spark, sf).select("id", value.alias("value_hundredths"), S.final_hundredths(value, F.col("tier")).alias("final_hundredths"))


RELEASE_TITLES = """CASE WHEN id % 5 = 0 THEN 'OpenAI 正式发布 GPT-6 模型' WHEN id % 5 = 1 THEN '传闻 Claude 将于下周发布' WHEN id % 5 = 2 THEN 'Claude Code 额度重置' ELSE title END"""
SELECTED = """
  SELECT *, CASE WHEN ai_focus = 'tangential' THEN 'ai_focus:tangential'
    WHEN source_id = 'src3' THEN CASE WHEN ai_focus = 'primary' AND impact >= 7 AND novelty >= 8 AND substance >= 9 THEN '+policy:source_gate:arxiv_breakthrough' ELSE 'source_gate:arxiv_not_breakthrough' END
    WHEN f >= 6500 THEN '+score:final_score'
    WHEN ai_focus = 'primary' AND category = 'model_release' AND id % 5 = 0 THEN '+policy:priority:confirmed_model_release'
    WHEN ai_focus = 'primary' AND category IN ('product_release', 'model_release') AND substance >= 4 AND id % 5 = 2 THEN '+policy:priority:usage_limit_update'
    ELSE 'final_score' END AS verdict
  FROM (SELECT *, least(10000, CAST(floor(100 * (least(impact, 10) * 4 + least(novelty, 10) * 3 + least(substance, 10) * 3)
     * CASE tier WHEN 'T1' THEN 12 WHEN 'T2' THEN 11 ELSE 10 END / 10.0 + 0.5) AS BIGINT)) AS f FROM scored)"""


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.scored(spark, sf).withColumn("title", F.expr(RELEASE_TITLES))
    value = S.value_hundredths(F.col("impact"), F.col("novelty"), F.col("substance"))
    source = F.when(F.col("source_id") == "src3", F.lit(S.PREPRINT_SOURCE)).otherwise(F.col("source_id"))
    verdict = S.selection(focus=F.col("ai_focus"), source_id=source, impact=F.col("impact"), novelty=F.col("novelty"),
                          substance=F.col("substance"), final=F.col("final_score"), category=F.col("category"), title=F.col("title"))
    return rows.withColumn("final_score", S.final_hundredths(value, F.col("tier"))).withColumn("verdict", verdict)


@query("selection_decision", f"""
SELECT id, starts_with(verdict, '+') AS selected, CASE WHEN starts_with(verdict, '+policy') OR starts_with(verdict, 'source_gate') THEN 'policy' ELSE 'score' END AS origin,
  regexp_replace(verdict, '^\\+(policy|score):', '') AS bucket FROM ({SELECTED})""")
def selection_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("id", "verdict.*")


@query("selection_transitions", f"""
SELECT coalesce(CAST(quality = 1 AS VARCHAR), 'none') AS before, starts_with(verdict, '+') AS after, count(*) AS n FROM ({SELECTED}) GROUP BY ALL""")
def selection_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.transitions(F.coalesce((F.col("quality") == 1).cast("string"), F.lit("none")), F.col("verdict.selected"), _selected(spark, sf))


@query("taxonomy", """
SELECT id, CASE category WHEN 'model_release' THEN 'model' WHEN 'product_release' THEN 'product' WHEN 'open_source' THEN 'product' WHEN 'research' THEN 'research'
    WHEN 'industry' THEN 'industry' WHEN 'funding' THEN 'industry' ELSE 'tutorial' END AS display,
  CASE WHEN category = 'opinion' THEN CASE WHEN p THEN 'product' WHEN m THEN 'model' WHEN t THEN 'technology' ELSE 'industry' END
    WHEN category = 'open_source' THEN CASE WHEN m THEN 'model' WHEN p THEN 'product' WHEN t THEN 'technology' ELSE 'product' END
    ELSE CASE category WHEN 'model_release' THEN 'model' WHEN 'product_release' THEN 'product' WHEN 'research' THEN 'technology'
      WHEN 'tutorial' THEN 'tutorial' ELSE 'industry' END END AS focus,
  CASE source_category WHEN 'official' THEN 'first_party' WHEN 'community' THEN 'community' ELSE 'news' END AS bucket
FROM (SELECT *, regexp_matches(lower(content), 'product|app|tool|platform|assistant|copilot|cursor|chatgpt|claude code|产品|应用|工具|平台|助手') AS p,
  regexp_matches(lower(content), 'model|models|llm|模型|权重|参数|checkpoint|gpt|claude|gemini|llama|deepseek|qwen|mistral|grok') AS m,
  regexp_matches(lower(content), 'paper|research|benchmark|dataset|method|algorithm|training|evaluation|论文|研究|评测|数据集|方法|算法|训练|微调') AS t FROM scored)""")
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return B.scored(spark, sf).select(
        "id", S.display_category(F.col("category")).alias("display"),
        S.resolve_focus(F.lit(None).cast("string"), F.col("category"), F.col("content")).alias("focus"), S.source_bucket(F.col("source_category")).alias("bucket"))


TOPIC_TITLES = "CASE id % 6 WHEN 0 THEN 'Meta, Llama and metadata' WHEN 1 THEN 'metadata only' WHEN 2 THEN '开源 agents by OpenAI' WHEN 3 THEN 'red team for 谷歌' ELSE title END"
TOPIC_VALUES = ", ".join("('{}', '{}')".format(name, P.keyword_pattern(words).replace("'", "''").replace("\\ ", " ").replace("\\-", "-")) for name, words in P.TOPICS.items())


def _topic_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.articles(spark, sf).withColumn("text", P.item_text(F.expr(TOPIC_TITLES), F.lit(""), F.array(F.col("source_id"))))
    return rows.select("id", local_day(F.col("published_at")).alias("day"), F.explode(P.derive_topics(F.col("text"))).alias("topic"))


TOPIC_MATCH_SQL = f"""
topics(topic, pattern) AS (VALUES {TOPIC_VALUES}),
matches AS (SELECT id, {DAY.format('published_at')} AS day, topic FROM articles JOIN topics
  ON regexp_matches(lower({TOPIC_TITLES} || '  ' || source_id), pattern))"""


@query("topic_matches", f", {TOPIC_MATCH_SQL} SELECT id, topic FROM matches")
def topic_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_matches(spark, sf).select("id", "topic")


@query("topic_index", f""", {TOPIC_MATCH_SQL} SELECT t.topic, count(id) AS count, count(*) FILTER (day >= DATE '2024-01-20' - 6) AS week_count,
  count(*) FILTER (day < DATE '2024-01-20' - 6 AND day >= DATE '2024-01-20' - 13) AS prev_week_count, strftime(max(day), '%Y-%m-%d') AS latest
FROM topics t LEFT JOIN matches m ON t.topic = m.topic GROUP BY t.topic""")
def topic_index(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in P.TOPICS], "topic string")
    return rank.topic_index(_topic_matches(spark, sf), names, "2024-01-20").withColumn("latest", F.col("latest").cast("string"))


# --- views ----------------------------------------------------------------

START, END = date(1995, 1, 1), date(1996, 12, 31)
LOWER, UPPER = day_bounds(START, END)


def _view(spark: SparkSession, sf: str, **options) -> DataFrame:
    m = checkpointed(B.membership(spark, sf))  # read six times below
    a = F.col("article_id")
    processed = m.select("article_id", "final_score", F.when(F.col("l_returnflag") == "R", "processed").otherwise("rejected").alias("status"),
                         F.array(F.lit("ai"), F.col("l_returnflag")).alias("tags"))
    raw = m.select("article_id", "source_id", "published_at", F.concat(F.lit("Report "), a).alias("title"))
    srcs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    overrides = m.where(a % 7 == 0).select("article_id", (a % 49 == 0).alias("hidden"), F.when(a % 2 == 0, F.concat(F.lit("Edited "), a)).otherwise("").alias("title"),
                                          F.when(a % 3 == 0, F.array().cast("array<string>")).alias("tags"))
    ev = table(spark, sf, "orders").where("o_orderkey % 11 = 0").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 33 == 0).alias("hidden"), F.lit(None).cast("string").alias("title"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("event"))).alias("tags"))
    member = m.where(F.col("l_linenumber") < 6).select("event_id", "article_id", "is_main")
    return views.all_events(processed, raw, srcs, overrides, ev, member, B.cluster_facts(m), START, END, **options)


VIEW_SQL = f"""
, chosen AS (SELECT DISTINCT event_id FROM membership WHERE l_returnflag = 'R' AND l_linenumber < 6),
view AS (
  SELECT m.article_id, CASE WHEN mm.is_main THEN CAST(mm.event_id AS VARCHAR) ELSE 'a' || substr(CAST(m.article_id AS VARCHAR), 1, 12) END AS event_id,
    coalesce(CASE WHEN m.article_id % 7 = 0 AND m.article_id % 2 = 0 THEN 'Edited ' || m.article_id END, 'Report ' || m.article_id) AS title,
    CASE WHEN mm.is_main AND m.event_id % 22 = 0 THEN 'event' WHEN m.article_id % 21 = 0 THEN '' ELSE 'ai,' || m.l_returnflag END AS tags,
    m.final_score, CASE WHEN m.l_returnflag = 'R' THEN 'processed' ELSE 'rejected' END AS status, m.published_at, m.source_id,
    coalesce(mm.is_main, true) AS is_main, coalesce(CASE WHEN mm.event_id IS NOT NULL THEN c.source_count END, 1) AS source_count,
    CASE WHEN mm.event_id IS NOT NULL THEN ch.event_id IS NOT NULL END AS chosen_event,
    CASE WHEN mm.event_id IS NULL THEN 'none' WHEN ch.event_id IS NOT NULL THEN 'true' ELSE 'false' END AS event_selected,
    m.article_id % 49 = 0 AS ov_hidden, coalesce(mm.is_main AND m.event_id % 33 = 0, false) AS ev_hidden, mm.event_id AS member_of
  FROM membership m JOIN supplier ON s_suppkey = m.source_id
  LEFT JOIN (SELECT * FROM membership WHERE l_linenumber < 6) mm ON mm.article_id = m.article_id
  LEFT JOIN clusters c ON c.event_id = mm.event_id LEFT JOIN chosen ch ON ch.event_id = mm.event_id
  WHERE m.published_at >= TIMESTAMP '{LOWER}' AND m.published_at < TIMESTAMP '{UPPER}')
"""
VIEW_COLUMNS = "article_id, event_id, title, tags, final_score, status, is_main, source_count, event_selected"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("article_id", "event_id", "title", F.array_join("tags", ",").alias("tags"), "final_score", "status", "is_main", "source_count",
                     F.coalesce(F.col("event_selected").cast("string"), F.lit("none")).alias("event_selected"))


@query("all_events_view", f"{VIEW_SQL} SELECT {VIEW_COLUMNS} FROM view WHERE NOT ov_hidden AND NOT ev_hidden")
def all_events_view(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_view(spark, sf))


@query("selected_semi_join", f"""{VIEW_SQL} SELECT {VIEW_COLUMNS} FROM view WHERE NOT ov_hidden AND NOT ev_hidden
AND CASE WHEN member_of IS NOT NULL THEN chosen_event ELSE status = 'processed' END""")
def selected_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_view(spark, sf, selected_only=True))


@query("admin_list", f"""{VIEW_SQL} SELECT article_id, title, ov_hidden OR ev_hidden AS hidden FROM view
WHERE contains(lower(title), 'edited') AND status = 'rejected'""")
def admin_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf, include_hidden=True)
    return rows.where(T.contains_all_terms(F.col("title"), "edited") & (F.col("status") == "rejected")).select("article_id", "title", "hidden")


@query("selected_feed", f"""{VIEW_SQL} SELECT article_id, event_id, source_count FROM view
WHERE NOT ov_hidden AND NOT ev_hidden AND is_main AND coalesce(chosen_event, status = 'processed')
ORDER BY published_at DESC, final_score DESC, source_count DESC, article_id LIMIT 50 OFFSET 10""")
def selected_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _view(spark, sf, selected_only=True).where("is_main")
    order = [F.desc("published_at"), F.desc("final_score"), F.desc("source_count"), "article_id"]
    return rank.page(rows, order, limit=50, offset=10).select("article_id", "event_id", "source_count")


@query("search_terms", "SELECT id FROM articles WHERE contains(lower(concat_ws(' ', title, content, source_id)), 'license') AND contains(lower(concat_ws(' ', title, content, source_id)), 'src1')")
def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "content", "source_id")
    return B.articles(spark, sf).where(T.contains_all_terms(text, "License SRC1")).select("id")


@query("query_terms", r"SELECT id FROM articles WHERE regexp_matches(content, '(?i)(^|[^a-z0-9])(mit[\s_-]+license|apache)([^a-z0-9]|$)')")
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return B.articles(spark, sf).where(F.col("content").rlike(T.term_pattern(["mit license", "apache"]))).select("id")


@query("paged_events", "SELECT article_id, event_id FROM membership ORDER BY published_at DESC, article_id LIMIT 50 OFFSET 100")
def paged_events(spark: SparkSession, sf: str) -> DataFrame:
    return rank.page(B.membership(spark, sf), [F.desc("published_at"), "article_id"], limit=50, offset=100).select("article_id", "event_id")


@query("items_by_ids", """
SELECT min(o_custkey) AS pos, i.event_id, i.final_score FROM orders JOIN items i ON i.event_id = CAST(o_orderkey AS VARCHAR) GROUP BY i.event_id, i.final_score""")
def items_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"))
    return views.items_by_ids(B.items(spark, sf), wanted).select("pos", "event_id", "final_score")


@query("coverage_list", """
SELECT event_id, article_id, row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC, article_id) AS pos
FROM membership WHERE article_id % 49 <> 0""")
def coverage_list(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    hidden = m.select("article_id", (F.col("article_id") % 49 == 0).alias("hidden"))
    raw = m.select("article_id", "source_id", "published_at")
    return views.coverage_list(m.select("event_id", "article_id", "is_main"), raw, hidden).select("event_id", "article_id", F.col("pos").cast("long").alias("pos"))


@query("main_flag_drift", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'wrong_flag' ELSE 'none_flagged' END AS drift FROM clusters c
WHERE event_id % 3 = 1 OR (event_id % 3 = 0 AND (SELECT count(*) FROM membership m WHERE m.event_id = c.event_id) > 1)""")
def main_flag_drift(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    last = Window.partitionBy("event_id").orderBy(F.desc("l_linenumber"))
    flags = m.withColumn("_n", F.row_number().over(last)).withColumn(
        "is_main", F.when(F.col("event_id") % 3 == 0, F.col("_n") == 1).when(F.col("event_id") % 3 == 1, F.lit(False)).otherwise(F.col("is_main")))
    return views.main_flag_drift(B.clusters(spark, sf), flags.select("event_id", "article_id", "is_main")).select("event_id", "drift")


# --- graph and clustering -------------------------------------------------

@query("redirect_closure", """
WITH RECURSIVE hops AS (
  SELECT c_custkey AS id, c_custkey AS target, 0 AS n FROM customer
  UNION ALL SELECT id, target - 7, n + 1 FROM hops WHERE target % 3 <> 0 AND target > 7 AND n < 8)
SELECT id, arg_max(target, n) AS target FROM hops GROUP BY id""", bound=False)
def redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    redirects = ids.where("id % 3 <> 0 and id > 7").select(F.col("id").alias("source_id"), (F.col("id") - 7).alias("target_id"))
    return graph.follow_redirects(ids, redirects)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("event_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, vec_id * 37)").alias("ts"))


@query("cosine_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, CAST(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000) AS BIGINT) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4
WHERE abs(a.vec_id - b.vec_id) * 37 <= 24 * 60 * 7""", bound=False)
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.similar_pairs(_vectors(spark, sf), threshold=0.4, span_hours=24 * 7).withColumn(
        "similarity", F.round(F.col("similarity") * 10000).cast("long"))


STORED_EVENTS = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label * 1000 + vec_id // {width} AS event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(vec_id * 37 AS INTEGER)) AS ts FROM embeddings),
spans AS (SELECT event_id, min(ts) AS lo, max(ts) AS hi FROM v GROUP BY event_id),
links AS (SELECT a.id AS article_id, m.event_id, round(min(list_cosine_similarity(a.vec, m.vec)), 9) AS weakest, any_value(a.ts) AS ts FROM v a, v m GROUP BY ALL),
fits AS (SELECT l.*, hi >= ts - INTERVAL {hours} HOUR AND greatest(hi, ts) - least(lo, ts) <= INTERVAL {hours} HOUR AS fits FROM links l JOIN spans USING (event_id))"""


def _stored(spark: SparkSession, sf: str, width: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, events of up to ``width`` steps of 37 minutes, and their members."""
    event = (F.col("event_id") * 1000 + F.floor(F.col("id") / width)).cast("long")
    v = _vectors(spark, sf).withColumn("event_id", event)
    articles = v.select(F.col("id").alias("article_id"), "vec", F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"))
    events = v.groupBy("event_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    return articles, events, v.select("event_id", F.col("id").alias("member_id"), "vec")


@query("nearest_events", f"""{STORED_EVENTS.format(hours=72, width=25)}
SELECT article_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY weakest DESC, event_id) AS place FROM fits WHERE fits AND weakest >= -0.05) WHERE place <= 2""", bound=False)
def nearest_events(spark: SparkSession, sf: str) -> DataFrame:
    return recall.nearest_events(*_stored(spark, sf), threshold=-0.05, k=2, window_hours=72).select(
        "article_id", "event_id", F.col("place").cast("long").alias("place"))


@query("nearest_recent_events", f"""{STORED_EVENTS.format(hours=24, width=25)}
SELECT article_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY weakest DESC, event_id) AS place FROM fits WHERE fits AND weakest >= 0.05) WHERE place = 1""", bound=False)
def nearest_recent_events(spark: SparkSession, sf: str) -> DataFrame:
    return recall.nearest_events(*_stored(spark, sf), threshold=0.05, window_hours=cluster.SPAN_HOURS).select("article_id", "event_id")


@query("verified_events", f"""{STORED_EVENTS.format(hours=48, width=10)},
means AS (SELECT event_id, list(x ORDER BY p) AS centroid FROM (SELECT event_id, p, avg(x) AS x FROM (
  SELECT event_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS p FROM v) GROUP BY ALL) GROUP BY event_id),
asked AS (SELECT l.article_id, l.event_id, bool_and((l.article_id + m.id) % 4 > 0) AS agreed,
  arg_max((l.article_id + m.id) % 4 > 0, (round(list_cosine_similarity(a.vec, m.vec), 12), -m.id)) AS nearest
  FROM links l JOIN v a ON a.id = l.article_id JOIN v m ON m.event_id = l.event_id GROUP BY ALL),
band AS (SELECT f.*, round(list_cosine_similarity(a.vec, centroid), 9) AS recall FROM fits f JOIN means USING (event_id) JOIN v a ON a.id = f.article_id WHERE weakest < 0.86),
placed AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY recall DESC, event_id) AS n FROM band WHERE recall >= 0.8),
found AS (SELECT article_id, event_id, false AS gray, weakest AS score FROM fits JOIN asked USING (article_id, event_id) WHERE fits AND weakest >= 0.86 AND agreed
  UNION ALL SELECT article_id, event_id, true, recall FROM placed JOIN asked USING (article_id, event_id) WHERE n <= 2 AND fits AND nearest)
SELECT article_id + 1000000 AS article_id, event_id, gray FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY gray, score DESC, event_id) AS place FROM found) WHERE place = 1""", bound=False)
def verified_events(spark: SparkSession, sf: str) -> DataFrame:
    articles, events, members = _stored(spark, sf, 10)
    articles = articles.withColumn("article_id", F.col("article_id") + 1_000_000)  # reports like a member, with ids of their own
    pairs = members.select("member_id", F.explode(F.sequence(F.col("member_id") - 100, F.col("member_id") + 100)).alias("other"))
    verdicts = pairs.select(F.col("member_id").alias("low_id"), (F.col("other") + 1_000_000).alias("high_id"), ((F.col("member_id") + F.col("other")) % 4 > 0).alias("same"))
    return recall.nearest_events(articles, events, members, threshold=0.86, window_hours=48, verdicts=verdicts).select("article_id", "event_id", "gray")


@query("centroid_recall", """
WITH parts AS (SELECT label AS event_id, p, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL),
means AS (SELECT event_id, list(x ORDER BY p) AS centroid FROM parts GROUP BY event_id)
SELECT article_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY affinity DESC, event_id) AS place FROM (
  SELECT vec_id AS article_id, event_id, list_cosine_similarity(embedding::DOUBLE[], centroid) AS affinity FROM embeddings, means) WHERE affinity >= 0.2) WHERE place <= 2""", bound=False)
def centroid_recall(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    articles = v.select(F.col("id").alias("article_id"), "vec")
    return recall.centroid_recall(articles, cluster.centroids(v.select("event_id", "vec")), floor=0.2).select("article_id", "event_id", F.col("place").cast("long").alias("place"))


@query("reference_matches", """
SELECT article_id, arg_max(event_id, (final_score, source_count, event_id)) AS event_id FROM (
  SELECT id AS article_id, unnest([id % 50, id % 70]) AS k FROM articles)
JOIN (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(event_id AS BIGINT) % 997 AS k, final_score, source_count FROM items) USING (k) GROUP BY article_id""")
def reference_matches(spark: SparkSession, sf: str) -> DataFrame:
    articles = B.articles(spark, sf).select(F.col("id").alias("article_id"), F.array(F.col("id") % 50, F.col("id") % 70).alias("keys"))
    events = B.items(spark, sf).select(F.col("event_id").cast("long").alias("event_id"), F.array(F.col("event_id").cast("long") % 997).alias("keys"), "final_score",
                                       "source_count", F.lit(True).alias("can_be_main"), F.lit("signal").alias("role"), F.lit("T1").alias("tier"),
                                       F.lit(NOW).alias("last_seen_at"))
    return cluster.reference_matches(articles, events)


@query("bigram_affinity", r"""
SELECT a, b, CAST(round(10000 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) AS BIGINT) AS affinity FROM (
  SELECT a.id AS a, b.id AS b, a.g AS x, b.g AS y FROM g a JOIN g b ON b.id = a.id + 1) WHERE len(list_concat(x, y)) > 0""".replace("FROM g a", "FROM (SELECT id, g FROM g) a"))
def bigram_affinity(spark: SparkSession, sf: str) -> DataFrame:
    g = B.articles(spark, sf).select("id", T.bigrams(F.col("title")).alias("g"))
    other = g.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("g").alias("h"))
    return g.join(other, "id").where((F.size("g") > 0) | (F.size("h") > 0)).select(
        F.col("id").alias("a"), "b", F.round(F.size(F.array_intersect("g", "h")) * 10000 / F.size(F.array_union("g", "h"))).cast("long").alias("affinity"))


ORACLE["bigram_affinity"] = ORACLE["bigram_affinity"].rstrip().replace("\nSELECT a, b, CAST", r""", g AS (
  SELECT id, list_distinct(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2))) AS g
  FROM (SELECT id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\x{3400}-\x{9FFF}]+', '', 'g') AS t FROM articles))
SELECT a, b, CAST""")


#: Pairs of titles that one task compares.
PAIR_ROWS = 4000


@query("sequence_affinity")
def sequence_affinity(spark: SparkSession, sf: str) -> DataFrame:
    g = B.articles(spark, sf).select("id", "title")
    pairs = g.join(g.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("title").alias("right_title")), "id")
    tasks = max(1, -(-table(spark, sf, "documents").count() // PAIR_ROWS))  # from the footers of the files
    return cluster.text_affinity(pairs.withColumnRenamed("title", "left_title"), tasks=tasks).select(F.col("id").alias("a"), "b", "bigram", "sequence", "affinity")


@query("cluster_articles")
def cluster_articles(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).select(F.col("id"), "vec")
    rows = B.scored(spark, sf).join(v, "id", "left").select(
        F.col("id").alias("article_id"), F.col("published_at").alias("ts"), F.col("id").alias("ord"), "vec",
        F.when(F.col("id") % 10 == 0, F.array(F.concat(F.lit("k"), (F.col("id") / 20).cast("long")))).otherwise(F.array().cast("array<string>")).alias("keys"),
        "can_be_main", "role", "tier", F.col("impact").cast("double").alias("final_score"), F.length("content").alias("content_length"))
    return cluster.cluster_articles(rows, threshold=0.3)


@query("choose_main", """
SELECT event_id, arg_max(article_id, (source_id % 3 <> 2, CASE source_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END, final_score, published_at, -article_id)) AS main_article_id
FROM membership GROUP BY event_id""")
def choose_main(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("source_id") % 3
    rows = B.membership(spark, sf).select(
        "event_id", "article_id", (n != 2).alias("can_be_main"), F.when(n == 0, "authority").when(n == 1, "signal").otherwise("aggregator").alias("role"),
        F.lit("T1").alias("tier"), "final_score", "published_at", F.lit("").alias("content"), F.col("article_id").alias("ord"))
    return views.choose_main(rows).select("event_id", F.col("article_id").alias("main_article_id"))


@query("merge_rank", """
SELECT event_id, row_number() OVER (ORDER BY CAST(event_id AS BIGINT) % 2 = 0 DESC, final_score DESC, source_count DESC, last_seen_at DESC, event_id DESC) AS merge_rank FROM items""")
def merge_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.items(spark, sf).select("event_id", (F.col("ord") % 2 == 0).alias("can_be_main"), F.lit("signal").alias("role"), F.lit("T1").alias("tier"),
                                     "final_score", "source_count", "last_seen_at")
    return cluster.merge_rank(rows).select("event_id", F.col("merge_rank").cast("long").alias("merge_rank"))


@query("distinct_sources", "SELECT event_id, count(DISTINCT CASE WHEN source_id % 4 = 0 THEN 'x:@h' || (source_id % 8) ELSE CAST(source_id AS VARCHAR) END) AS sources FROM membership GROUP BY event_id")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    handle = F.when(F.col("source_id") % 4 == 0, F.concat(F.lit("H"), F.col("source_id") % 8))
    key = views.evidence_key(F.col("source_id").cast("string"), handle)
    return B.membership(spark, sf).groupBy("event_id").agg(F.count_distinct(key).alias("sources"))


@query("main_similarity", """
SELECT m.vec_id AS article_id, CAST(round(10000 * CASE WHEN m.vec_id = x.main THEN 1.0 ELSE list_cosine_similarity(m.embedding::DOUBLE[], e.embedding::DOUBLE[]) END) AS BIGINT) AS similarity
FROM embeddings m JOIN (SELECT label, min(vec_id) AS main FROM embeddings GROUP BY label) x USING (label) JOIN embeddings e ON e.vec_id = x.main""", bound=False)
def main_similarity(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumn("norm", norm(F.col("vec")))
    main = v.groupBy("event_id").agg(F.min_by(F.struct(F.col("id").alias("main"), F.col("vec").alias("mvec"), F.col("norm").alias("mnorm")), "id").alias("m")).select("event_id", "m.*")
    score = F.when(F.col("id") == F.col("main"), F.lit(1.0)).otherwise(cosine(F.col("vec"), F.col("mvec"), F.col("norm"), F.col("mnorm")))
    return v.join(main, "event_id").select(F.col("id").alias("article_id"), F.round(score * 10000).cast("long").alias("similarity"))


# --- ledgers --------------------------------------------------------------

def _usage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce(F.col("score_cents"), F.lit(0))
    return B.reports(spark, sf).select(
        F.col("ts").alias("recorded_at"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.col("source_key").alias("operation"),
        F.lit(1).alias("calls"), k.alias("prompt_tokens"), (F.col("article_id") % 100).alias("cache_hit_tokens"), (k + 1).alias("cache_miss_tokens"),
        (F.col("article_id") % 7).alias("completion_tokens"), (F.col("article_id") % 3).alias("reasoning_tokens"))


USAGE_SQL = """, usage AS (SELECT ts, 'm' || (event_id % 3) AS model, source_key AS operation, coalesce(score_cents, 0) AS prompt_tokens,
  article_id % 100 AS cache_hit_tokens, coalesce(score_cents, 0) + 1 AS cache_miss_tokens, article_id % 7 AS completion_tokens, article_id % 3 AS reasoning_tokens FROM reports)"""


@query("usage_by_day", f"""{USAGE_SQL} SELECT strftime({DAY.format('ts')}, '%Y-%m-%d') AS day, model, operation, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens, CAST(sum(cache_miss_tokens) AS BIGINT) AS cache_miss_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens FROM usage GROUP BY ALL""")
def usage_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.usage_by_day(_usage(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("usage_cost", f"""{USAGE_SQL} SELECT model, operation, count(*) AS calls,
  CAST(sum(cache_hit_tokens * 1 + cache_miss_tokens * 4 + completion_tokens * 16) AS BIGINT) AS cost_micro,
  CAST(sum(cache_hit_tokens) AS BIGINT) AS hit_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens FROM usage GROUP BY ROLLUP (model, operation)""")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame([(f"m{i}", 1, 4, 16) for i in range(3)], "model string, hit_price long, miss_price long, out_price long")
    return ledger.usage_cost(_usage(spark, sf), prices)


@query("health_average", """, log AS (SELECT event_id AS source_id, ts, article_id, CASE WHEN source_key <> 'error' THEN 1 ELSE 0 END AS ok,
  row_number() OVER (PARTITION BY event_id ORDER BY ts, article_id) AS n FROM reports)
SELECT source_id, list_reduce(list(CAST(ok * 10000 AS BIGINT) ORDER BY n), lambda a, x: CAST(round(0.8 * a + 0.2 * x) AS BIGINT)) / 10000.0::DOUBLE AS success_rate,
  CAST(count(*) - coalesce(max(n) FILTER (ok = 1), 0) AS INTEGER) AS error_count, count(*) AS observations FROM log GROUP BY source_id""")
def health_average(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.reports(spark, sf).select(F.col("event_id").alias("source_id"), "ts", F.col("article_id").alias("ord"), (F.col("source_key") != "error").alias("ok"))
    return ledger.health_average(rows)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return B.reports(spark, sf).select(F.col("event_id").alias("source_id"), "ts", F.col("article_id").alias("ord"), F.col("source_key").alias("model"))


@query("model_segments", """SELECT source_id, ord, model FROM (SELECT event_id AS source_id, article_id AS ord, source_key AS model,
  lag(source_key) OVER (PARTITION BY event_id ORDER BY ts, article_id) AS before FROM reports) WHERE before IS NULL OR before <> model""")
def model_segments(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.model_segments(_runs(spark, sf), keys=["source_id"]).select("source_id", "ord", "model")


@query("asof_model", """, segs AS (SELECT event_id, max(ts) AS ts, arg_max(source_key, (ts, article_id)) AS model FROM reports GROUP BY event_id, ts)
SELECT o.o_orderkey AS id, coalesce(s.model, 'legacy') AS model FROM
  (SELECT o_orderkey, o_custkey % 150 AS k, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 40000 AS INTEGER)) AS t FROM orders) o
ASOF LEFT JOIN segs s ON o.k = s.event_id AND o.t >= s.ts""")
def asof_model(spark: SparkSession, sf: str) -> DataFrame:
    segments = _runs(spark, sf).groupBy("source_id", "ts").agg(F.max_by("model", "ord").alias("model"))
    moments = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 150).cast("long").alias("source_id"), F.col("o_orderkey").cast("long").alias("id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(o_orderkey % 40000 as int))").alias("ts"))
    return ledger.asof_model(moments, segments, key="source_id", legacy="legacy").select("id", "model")


@query("score_range", "SELECT coalesce(model_used, '') AS model, count(*) AS n, min(final_score) AS lowest, max(final_score) AS highest FROM items GROUP BY ALL")
def score_range(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.score_range(B.items(spark, sf))


@query("run_ledger", """SELECT o_orderkey AS id, raw - CASE WHEN o_orderkey % 5 <> 0 THEN raw // 2 END - 1 AS duplicate_count FROM
  (SELECT *, CAST(o_totalprice AS BIGINT) AS raw FROM (SELECT o_orderkey, o_orderdate, floor(o_totalprice) AS o_totalprice FROM orders)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""", bound=False)
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.floor("o_totalprice").cast("long")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), raw.alias("raw_count"),
                                             F.when(F.col("o_orderkey") % 5 != 0, F.floor(raw / 2)).alias("new_raw_count"), F.lit(1).alias("non_ai_dropped_count"))
    return ledger.run_metrics(runs).select("id", "duplicate_count")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("documents", "events", "orders", "pages")), bound=False)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.table_counts({t: table(spark, sf, t) for t in ("documents", "events", "orders", "pages")})


# --- ranking and reports --------------------------------------------------

RANKED = """, ranked AS (SELECT *, row_number() OVER (ORDER BY r / n, final_score DESC, event_id) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(model_used, '') ORDER BY final_score DESC, ord)::DOUBLE AS r, count(*) OVER (PARTITION BY coalesce(model_used, ''))::DOUBLE AS n FROM items))"""


@query("model_rank", f"{RANKED} SELECT event_id, CAST(r AS BIGINT) AS model_rank, position FROM ranked")
def model_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.model_rank(B.items(spark, sf)).select("event_id", F.col("model_rank").cast("long").alias("model_rank"), F.col("position").cast("long").alias("position"))


@query("weekly_roster", f"""{RANKED}, w AS (SELECT *, strftime({DAY.format('last_seen_at')}, '%G-W%V') AS week FROM ranked),
p AS (SELECT *, source_count > 1 AS multi, count(*) FILTER (source_count > 1) OVER (PARTITION BY category) AS m,
  row_number() OVER (PARTITION BY category, source_count > 1 ORDER BY days_covered DESC, position) AS nth FROM w),
k AS (SELECT *, multi OR nth <= greatest(0, 2 - m) AS kept FROM p),
q AS (SELECT *, count(*) FILTER (kept) OVER () AS n_kept, row_number() OVER (PARTITION BY kept ORDER BY days_covered DESC, position) AS rest FROM k)
SELECT event_id, row_number() OVER (ORDER BY multi DESC, days_covered DESC, position) AS slot FROM q WHERE kept OR rest <= 40 - n_kept""")
def weekly_roster(spark: SparkSession, sf: str) -> DataFrame:
    return rank.weekly_roster(B.items(spark, sf)).select("event_id", F.col("slot").cast("long").alias("slot"))


@query("monthly_roster", f"""{RANKED}, e AS (SELECT *, source_count > 1 OR days_covered >= 2 AS able, source_count > 1 AS multi FROM ranked),
n AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY multi DESC, days_covered DESC, position) AS nth FROM e)
SELECT event_id, nth AS slot FROM n WHERE able AND nth <= 25""")
def monthly_roster(spark: SparkSession, sf: str) -> DataFrame:
    return rank.monthly_roster(B.items(spark, sf)).select("event_id", F.col("slot").cast("long").alias("slot"))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return B.reports(spark, sf).select(
        F.col("event_id").cast("string").alias("event_id"), local_day(F.col("ts")).alias("report_date"), F.col("article_id").alias("pos"),
        F.col("score_cents").alias("final_score"), (F.col("article_id") % 4).alias("source_count"), F.col("source_key").alias("title"))


DAILY_SQL = f""", daily AS (SELECT CAST(event_id AS VARCHAR) AS event_id, {DAY.format('ts')} AS report_date, article_id AS pos, score_cents AS final_score,
  article_id % 4 AS source_count, source_key AS title FROM reports)"""


@query("daily_two_tier", f"""{DAILY_SQL} SELECT strftime(report_date, '%Y-%m-%d') AS report_date, pos, row_number() OVER (PARTITION BY report_date ORDER BY source_count > 1 DESC, final_score DESC NULLS LAST, event_id || '-' || lpad(pos::VARCHAR, 12, '0')) AS slot FROM daily""")
def daily_two_tier(spark: SparkSession, sf: str) -> DataFrame:
    rows = _daily(spark, sf).withColumn("event_id", F.concat("event_id", F.lit("-"), F.lpad(F.col("pos").cast("string"), 12, "0")))
    return rank.daily_order(rows).select(F.col("report_date").cast("string").alias("report_date"), "pos", F.col("slot").cast("long").alias("slot"))


@query("merge_dailies", f"""{DAILY_SQL} SELECT event_id, arg_max(title, (report_date, pos)) AS title, arg_max(final_score, (report_date, pos)) AS final_score,
  count(DISTINCT report_date) AS days_covered FROM daily GROUP BY event_id""")
def merge_dailies(spark: SparkSession, sf: str) -> DataFrame:
    return rank.merge_dailies(_daily(spark, sf)).select("event_id", "title", "final_score", "days_covered")


@query("period_stats", """SELECT category, count(DISTINCT source_id) AS source_coverage_count, count(*) FILTER (source_count > 1) AS multi_source_count, count(*) AS coverage_count
FROM items GROUP BY category""")
def period_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rank.period_stats(B.items(spark, sf), ["category"]).drop("multi_source_ratio")


@query("storylines", f"""SELECT event_id, source_count, CAST({DAY.format('last_seen_at')} - {DAY.format('first_seen_at')} + 1 AS INTEGER) AS days FROM items
WHERE {DAY.format('last_seen_at')} - {DAY.format('first_seen_at')} + 1 >= 2 ORDER BY source_count DESC, days DESC, {DAY.format('last_seen_at')} DESC, event_id LIMIT 5""")
def storylines(spark: SparkSession, sf: str) -> DataFrame:
    return rank.storylines(B.items(spark, sf)).select("event_id", "source_count", "days")


@query("sitemap", "SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(max(published_at)) AS last_modified FROM membership WHERE is_main AND event_id % 5 <> 0 GROUP BY event_id")
def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.membership(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), "is_main", (F.col("event_id") % 5 == 0).alias("hidden"),
                                          F.lit("t").alias("title"), F.lit("s").alias("summary"), F.unix_micros("published_at").alias("last_modified"))
    return rank.sitemap(rows)


# --- writes ---------------------------------------------------------------

@query("insert_missing", """SELECT min(o_orderkey) AS id, o_custkey AS url_hash FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey""", bound=False)
def insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url_hash"))
    incoming = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("url_hash"))
    return upsert.insert_missing(stored, incoming, "url_hash", "id")


@query("upsert_merge", """SELECT url_hash, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND (length(n.content) > length(o.content) OR n.extractor > o.extractor)) THEN n.content ELSE o.content END AS content,
  greatest(o.extractor, n.extractor) AS extractor, epoch_us(coalesce(n.published_at, o.published_at)) AS published_at
FROM (SELECT id AS url_hash, id, source_id AS content, 2 AS extractor, published_at FROM articles WHERE id % 2 = 0) o
FULL JOIN (SELECT id AS url_hash, id + 1000000 AS id, language || source_id AS content, CAST(id % 4 AS INTEGER) AS extractor, CASE WHEN id % 6 = 0 THEN published_at + INTERVAL 1 DAY END AS published_at FROM articles WHERE id % 3 = 0) n USING (url_hash)""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = B.articles(spark, sf)
    i = F.col("id")
    stored = a.where("id % 2 = 0").select(i.alias("url_hash"), "id", F.col("source_id").alias("content"), F.lit(2).alias("extractor"), "published_at")
    incoming = a.where("id % 3 = 0").select(i.alias("url_hash"), (i + 1000000).alias("id"), F.concat("language", "source_id").alias("content"), (i % 4).cast("int").alias("extractor"),
                                            F.when(i % 6 == 0, F.col("published_at") + F.expr("INTERVAL 1 DAY")).alias("published_at"))
    rules = upsert.article_rules() | {"url_hash": F.coalesce("old.url_hash", "new.url_hash")}
    return upsert.upsert(stored, incoming, "url_hash", rules).withColumn("published_at", F.unix_micros("published_at"))


@query("promote_after_delete", """, left_over AS (SELECT * FROM membership WHERE article_id % 3 <> 0)
SELECT event_id, article_id, CASE WHEN bool_or(is_main) OVER (PARTITION BY event_id) THEN is_main
  ELSE article_id = last_value(article_id) OVER (PARTITION BY event_id ORDER BY published_at, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS is_main FROM left_over""")
def promote_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    m = B.membership(spark, sf)
    return upsert.promote_after_delete(m, m.where("article_id % 3 = 0")).select("event_id", "article_id", "is_main")


@query("manual_entries", """SELECT strftime(report_date, '%Y-%m-%d') AS report_date, mx + row_number() OVER (PARTITION BY report_date ORDER BY published_at, event_id) AS position, event_id FROM (
  SELECT o_orderdate::DATE AS report_date, o_orderkey AS event_id, o_totalprice AS published_at, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -1 END) OVER (PARTITION BY o_orderdate::DATE) AS mx, o_orderkey % 2 AS z FROM orders) WHERE z = 1""", bound=False)
def manual_entries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("report_date"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("published_at"))
    entries = o.where("event_id % 2 = 0").select("report_date", "event_id", F.col("event_id").alias("position"))
    return upsert.manual_entries(entries, o).select(F.col("report_date").cast("string").alias("report_date"), F.col("position").cast("long").alias("position"), "event_id")


@query("stream_replay", """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01 16:00:00')) AS day_start, event_id, count(*) AS reports, count(DISTINCT source_key) AS sources
FROM reports GROUP BY ALL""")
def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed stream itself, run over all events that are there."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]").select(
        F.col("user_id").alias("event_id"), F.col("event_type").alias("source_key"), F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
    return intake.replayed(intake.daily_coverage(stream), folder).select(
        F.unix_micros("day_start").alias("day_start"), "event_id", "reports", "sources")


from tidewire.plans import editing, events_at_work, more, paged_feeds, records, upkeep  # noqa: E402,F401  register their queries here too
