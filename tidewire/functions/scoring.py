"""Scores, the selection policy and the taxonomy as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the dimensions in tenths, tier factors in tenths.
WEIGHTS = {"impact": 4, "novelty": 3, "substance": 3}
TIER_TENTHS = {"T1": 12, "T2": 11}
THRESHOLD = 65.0
PREPRINT_SOURCE = "arxiv_ai"
PREPRINT_LEAST = {"impact": 7, "novelty": 8, "substance": 9}
USAGE_CATEGORIES = ["product_release", "model_release", "industry_news"]

# Phrases of confirmed and unconfirmed releases and of usage limits.
RELEASED = (
    r"(?i)(?:正式)?(?:发布|推出|上线|开放(?:使用|调用|权重)?|公测)"
    r"|(?:模型|权重).{0,8}开源|开源.{0,8}(?:模型|权重)"
    r"|\b(?:releases|released|launches|launched|introduces|introduced)\b"
    r"|\b(?:now|generally) available\b|\bopen[- ]weights?\b"
)
UNCONFIRMED = (
    r"(?i)消息称|爆料|传闻|泄露|预计|计划|规划|目标|拟于?|将于|即将|或将|或于|有望"
    r"|内测|灰测|内部测试|测试中|踪迹|曝光|预告|发布在即|延后|推迟"
    r"|或.{0,10}(?:发布|推出|上线|开放|开源|公测)"
    r"|(?:明日|明天|下周|月底|年内|周[一二三四五六日天]).{0,8}(?:发布|推出|上线|开放|开源|公测)"
    r"|将(?:正式)?(?:发布|推出|上线|开放|开源|公测)"
    r"|\b(?:reportedly|rumou?rs?|leaks?|plans? to|expected to|coming soon|next week|preview|testing|teases?)\b"
)
MODEL_NAMES = (
    r"(?i)(?:AI|人工智能)?(?:大|语言|推理|视频|图像|多模态|生成式)?模型"
    r"|\b(?:AI|foundation|language|reasoning|video|image|multimodal) models?\b"
    r"|\b(?:GPT|Claude|Gemini|GLM|Qwen|Llama|DeepSeek|Kimi|Grok|Mistral|Wan)\s*[-\w.]*\b"
    r"|(?:\bOpenAI\b.{0,24}\bo\d(?:[-\w.]*)?\b|\bo\d(?:[-\w.]*)?\b.{0,24}\bOpenAI\b)"
)
LIMIT_TERM = r"(?:额度|配额|限额|用量|使用上限|使用限制|usage limits?|rate limits?|quotas?)"
LIMIT_ACTION = (
    r"(?:重置|恢复|重启|上调|下调|提高|提升|增加|降低|减少|延长|取消|重新限制|调整|刷新"
    r"|reset|restore|restart|increase|decrease|extend|remove|adjust)"
)
LIMIT_CHANGED = rf"(?i)(?:{LIMIT_TERM}.{{0,24}}{LIMIT_ACTION}|{LIMIT_ACTION}.{{0,24}}{LIMIT_TERM})"
NO_LIMIT = r"(?i)(?:无|取消|without|no).{0,12}(?:使用)?(?:限制|限额|limit)"
CLAUSE_END = r"[\n，,。；;：:！!？?]+"

# Content categories, their display group and their focus.
DISPLAY_OF = {
    "model_release": "model", "product_release": "product", "open_source": "product", "industry": "industry",
    "funding": "industry", "research": "research", "opinion": "tutorial", "tutorial": "tutorial",
}
FOCUS_OF = {
    "model_release": "model", "product_release": "product", "open_source": "product", "research": "technology",
    "industry": "industry", "funding": "industry", "opinion": "industry", "tutorial": "tutorial",
}
DISPLAY_LABELS = {"model": "模型", "product": "产品", "industry": "行业", "research": "论文", "tutorial": "技巧"}
FOCUS_LABELS = {
    "model": "模型动态", "product": "产品工具", "technology": "技术研究", "industry": "行业动态", "tutorial": "教程实践",
}
SCORING_LABELS = {
    "model_release": "模型进展", "product_release": "产品应用", "open_source": "开源项目", "research": "研究评测",
    "industry": "行业事件", "funding": "资本动态", "tutorial": "教程实践", "opinion": "观点分析",
}
# Words in free-form categories, in order of precedence.
DISPLAY_WORDS = [
    ("model", "model"), ("research", "research"), ("paper", "research"), ("academic", "research"),
    ("product", "product"), ("open_source", "product"), ("tool", "product"), ("framework", "product"),
    ("launch", "product"), ("release", "product"), ("tutorial", "tutorial"), ("opinion", "tutorial"),
    ("technique", "tutorial"), ("funding", "industry"),
]
FOCUS_WORDS = [
    ("model", "model"), ("research", "technology"), ("paper", "technology"), ("academic", "technology"),
    ("benchmark", "technology"), ("technique", "technology"), ("tutorial", "tutorial"), ("product", "product"),
    ("open_source", "product"), ("tool", "product"), ("framework", "product"), ("launch", "product"),
    ("release", "product"), ("funding", "industry"), ("policy", "industry"), ("regulation", "industry"),
    ("opinion", "industry"),
]
# Words in texts that point to a focus.
MODEL_SIGNALS = [
    "model", "models", "llm", "模型", "权重", "参数", "checkpoint", "gpt", "claude", "gemini", "llama", "deepseek",
    "qwen", "mistral", "grok",
]
PRODUCT_SIGNALS = [
    "product", "app", "tool", "platform", "assistant", "copilot", "cursor", "chatgpt", "claude code", "产品", "应用",
    "工具", "平台", "助手",
]
TECHNOLOGY_SIGNALS = [
    "paper", "research", "benchmark", "dataset", "method", "algorithm", "training", "evaluation", "论文", "研究",
    "评测", "数据集", "方法", "算法", "训练", "微调",
]


def _mapped(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def value_hundredths(impact: Column, novelty: Column, substance: Column) -> Column:
    """The value score in hundredths, exact: dimensions as decimals in 0..10."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(10), c.cast("decimal(12,6)")))
    total = sum(
        (clamp(c) * w for c, w in zip((impact, novelty, substance), WEIGHTS.values(), strict=True)), F.lit(0)
    )
    return F.round(F.least(F.greatest(total, F.lit(0)), F.lit(100)) * 100).cast("long")


def final_hundredths(value: Column, tier: Column) -> Column:
    """The value in hundredths times the tier's factor, at most 10000."""
    factor = F.lit(10)
    for name, tenths in TIER_TENTHS.items():
        factor = F.when(tier == name, F.lit(tenths)).otherwise(factor)
    return F.least(F.lit(10000), F.round((value * factor).cast("decimal(18,0)") / 10).cast("long"))


def _any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_word(text: Column, words: list[tuple[str, str]]) -> Column:
    found = F.lit(None).cast("string")
    for word, name in reversed(words):
        found = F.when(text.contains(word), F.lit(name)).otherwise(found)
    return found


def _key(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def valid_focus(focus: Column) -> Column:
    """The focus if it is one of the five, else null."""
    return F.when(_key(focus).isin(list(FOCUS_LABELS)), _key(focus))


def infer_focus(category: Column, text: Column) -> Column:
    """Focus of a row without one, from its category and its text."""
    raw, body = _key(category), F.lower(F.coalesce(text, F.lit("")))
    product, model, technology = (
        _any_word(body, w) for w in (PRODUCT_SIGNALS, MODEL_SIGNALS, TECHNOLOGY_SIGNALS)
    )
    by_text = F.when(technology, F.lit("technology"))
    opinion = F.when(product, F.lit("product")).when(model, F.lit("model")).otherwise(by_text)
    open_source = F.when(model, F.lit("model")).when(product, F.lit("product")).otherwise(by_text)
    special = F.when(raw == "opinion", opinion).when(raw == "open_source", open_source)
    return F.coalesce(valid_focus(raw), special, _mapped(raw, FOCUS_OF), _first_word(raw, FOCUS_WORDS))


def resolve_focus(focus: Column, category: Column, text: Column) -> Column:
    """The stored focus if valid, else the inferred one."""
    return F.coalesce(valid_focus(focus), infer_focus(category, text))


def display_category(category: Column) -> Column:
    """One of the five display groups; industry if nothing fits."""
    raw = _key(category)
    own = F.when(raw.isin(list(DISPLAY_LABELS)), raw)
    return F.coalesce(own, _mapped(raw, DISPLAY_OF), _first_word(raw, DISPLAY_WORDS), F.lit("industry"))


def category_label(category: Column) -> Column:
    return _mapped(display_category(category), DISPLAY_LABELS)


def focus_label(focus: Column) -> Column:
    return F.coalesce(_mapped(valid_focus(focus), FOCUS_LABELS), F.lit("未分类"))


def scoring_label(category: Column) -> Column:
    raw = _key(category)
    return F.coalesce(_mapped(raw, SCORING_LABELS), F.when(raw == "", F.lit("未分类")).otherwise(raw))


def source_bucket(category: Column) -> Column:
    """first_party, community or news."""
    raw = _key(category)
    return (
        F.when(raw.isin("official", "research"), F.lit("first_party"))
        .when(raw == "community", F.lit("community"))
        .otherwise(F.lit("news"))
    )


def confirmed_release(category: Column, title: Column) -> Column:
    """A model's title with a clause that says released and not perhaps."""
    clauses = F.split(title, CLAUSE_END)
    sure = F.exists(clauses, lambda c: c.rlike(RELEASED) & ~c.rlike(UNCONFIRMED))
    return (category == "model_release") & title.rlike(MODEL_NAMES) & sure


def usage_update(category: Column, substance: Column, title: Column) -> Column:
    """A stated change of usage limits."""
    changed = title.rlike(LIMIT_CHANGED) | title.rlike(NO_LIMIT)
    return category.isin(USAGE_CATEGORIES) & (substance >= 4) & changed


def selection(*, focus, source_id, impact, novelty, substance, final, category, title) -> Column:
    """struct(selected, origin, bucket): the first rule that speaks decides.

    ``final`` is in hundredths; ``bucket`` is the coarse reason.
    """
    def verdict(selected: bool, origin: str, bucket: Column | str) -> Column:
        bucket = F.lit(bucket) if isinstance(bucket, str) else bucket
        return F.struct(F.lit(selected).alias("selected"), F.lit(origin).alias("origin"), bucket.alias("bucket"))

    breakthrough = (
        (focus == "primary") & (impact >= PREPRINT_LEAST["impact"]) & (novelty >= PREPRINT_LEAST["novelty"])
        & (substance >= PREPRINT_LEAST["substance"])
    )
    preprint = source_id == PREPRINT_SOURCE
    primary = focus == "primary"
    return (
        F.when(~F.coalesce(focus.isin("primary", "contributing"), F.lit(False)),
               verdict(False, "score", F.concat(F.lit("ai_focus:"), F.coalesce(focus, F.lit("None")))))
        .when(preprint & breakthrough, verdict(True, "policy", "source_gate:arxiv_breakthrough"))
        .when(preprint, verdict(False, "policy", "source_gate:arxiv_not_breakthrough"))
        .when(final >= int(THRESHOLD * 100), verdict(True, "score", "final_score"))
        .when(primary & confirmed_release(category, title), verdict(True, "policy", "priority:confirmed_model_release"))
        .when(primary & usage_update(category, substance, title), verdict(True, "policy", "priority:usage_limit_update"))
        .otherwise(verdict(False, "score", "final_score"))
    )
