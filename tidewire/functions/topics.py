"""Topic registry and topic membership."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics in registry order, with their keywords.
TOPICS: dict[str, list[str]] = {
    "openai": ["openai", "chatgpt", "gpt", "sora", "o3", "o4"],
    "anthropic": ["anthropic", "claude"],
    "google": ["google", "deepmind", "gemini", "谷歌", "veo", "notebooklm"],
    "deepseek": ["deepseek", "深度求索"],
    "qwen": ["qwen", "通义", "千问", "阿里", "alibaba"],
    "kimi": ["kimi", "moonshot", "月之暗面"],
    "zhipu": ["智谱", "glm", "zhipu"],
    "minimax": ["minimax", "海螺"],
    "bytedance": ["bytedance", "字节", "豆包", "doubao", "火山引擎", "即梦"],
    "tencent": ["tencent", "腾讯", "混元", "hunyuan"],
    "baidu": ["baidu", "百度", "文心", "ernie"],
    "xai": ["xai", "grok"],
    "meta": ["meta", "llama"],
    "microsoft": ["microsoft", "微软", "azure", "copilot"],
    "nvidia": ["nvidia", "英伟达", "cuda"],
    "huggingface": ["hugging face", "huggingface"],
    "cursor": ["cursor"],
    "amazon": ["amazon", "aws", "亚马逊", "bedrock", "trainium"],
    "apple": ["apple", "苹果", "siri"],
    "huawei": ["huawei", "华为", "昇腾", "盘古", "ascend"],
    "openrouter": ["openrouter"],
    "perplexity": ["perplexity"],
    "mistral": ["mistral"],
    "iflytek": ["iflytek", "讯飞", "星火"],
    "stepfun": ["stepfun", "阶跃"],
    "midjourney": ["midjourney"],
    "agents": ["agent", "agents", "智能体", "mcp", "多智能体"],
    "coding": ["coding", "code", "编码", "编程", "程序员", "vibe coding"],
    "reasoning": ["reasoning", "推理"],
    "multimodal": ["multimodal", "vision", "多模态", "文生图", "文生视频", "图像生成", "视频生成", "图像编辑"],
    "voice": ["voice", "speech", "audio", "语音", "音频", "音乐生成"],
    "embodied": ["robot", "robotics", "机器人", "具身", "人形"],
    "opensource": ["open source", "open-source", "开源"],
    "safety": ["safety", "alignment", "安全", "对齐", "红队", "red team", "越狱", "jailbreak"],
}
# Older ids of topics.
ALIASES = {
    "gpt": "openai", "chatgpt": "openai", "sora": "openai", "claude": "anthropic", "claude_code": "anthropic",
    "gemini": "google", "llama": "meta", "grok": "xai", "copilot": "microsoft", "alibaba": "qwen",
    "robotics": "embodied",
}


def keyword_pattern(keywords: list[str]) -> str:
    """ASCII keywords on word bounds, others anywhere."""
    bounded = [re.escape(k) for k in keywords if k.isascii()]
    free = [re.escape(k) for k in keywords if not k.isascii()]
    parts = [rf"(?:^|[^a-z0-9])(?:{'|'.join(bounded)})(?:[^a-z0-9]|$)"] if bounded else []
    return "|".join(parts + free)


def item_text(title: Column, line: Column, tags: Column) -> Column:
    """What the topic rules read: title, one-line summary and tags, lower-cased."""
    empty = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(title, empty), F.coalesce(line, empty),
                               F.coalesce(F.array_join(tags, " "), empty)))


def matches_topic(topic: str, topic_ids: Column, text: Column) -> Column:
    """Stored ids decide, an empty list included; keywords only where they are null."""
    topic = ALIASES.get(topic, topic)
    if topic not in TOPICS:
        return F.lit(False)
    by_word = text.rlike(keyword_pattern(TOPICS[topic]))
    return F.when(topic_ids.isNotNull(), F.array_contains(topic_ids, topic)).otherwise(by_word)


def derive_topics(text: Column) -> Column:
    """Ids of all topics whose keywords occur, in registry order."""
    found = [F.when(text.rlike(keyword_pattern(words)), F.lit(name)) for name, words in TOPICS.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def normalize_topics(values: Column) -> Column:
    """Aliases resolved, unknown ids dropped, first occurrences kept; null stays."""
    pairs = [F.lit(x) for pair in ALIASES.items() for x in pair]
    table = F.create_map(*pairs)
    named = F.transform(values, lambda v: F.coalesce(F.try_element_at(table, F.lower(F.trim(v))), F.lower(F.trim(v))))
    return F.array_distinct(F.filter(named, lambda v: v.isin(list(TOPICS))))
