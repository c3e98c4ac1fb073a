"""Text normalisation, hashing, URLs and languages as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters that a canonical URL drops.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref"]
# Those that a reference key drops besides the prefix.
REFERENCE_TRACKING_KEYS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "spm"]
# Hosts whose status pages are one post.
POST_HOSTS = ["mobile.twitter.com", "twitter.com", "www.twitter.com", "x.com", "www.x.com"]
# Column names that mark a digest headline, and its separators.
DIGEST_COLUMNS = "早报|晚报|午报|日报|周报|快讯|简讯|速览|要闻"
DIGEST_MARKER = rf"^[^：:｜|]{{0,4}}({DIGEST_COLUMNS})\s*[0-9]{{0,6}}\s*[｜|：:]\s*(.+)$"
DIGEST_SEPARATORS = "[/／；;、]"

CJK = r"[\x{4E00}-\x{9FFF}]"
ITEM_CJK = r"[^a-z0-9\x{3400}-\x{9FFF}]+"


def clean_text(value: Column) -> Column:
    """White space of any script collapsed to single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def strip_html(value: Column) -> Column:
    """Tags become spaces, then white space collapses."""
    return clean_text(F.regexp_replace(F.coalesce(value, F.lit("")), r"<[^>]+>", " "))


def stable_hash(value: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(value.cast("binary"), 256)


def short_hash(value: Column, length: int = 16) -> Column:
    """The leading hex digits of the stable hash."""
    return F.substring(stable_hash(value), 1, length)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _parameters(query: Column, keys: list[str]) -> Column:
    """The parameters that are no tracking ones, each as ``name=value``."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~name(p).startswith(TRACKING_PREFIX) & ~name(p).isin(keys))
    return F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))


def _decoded(part: Column) -> Column:
    """Escapes and plus signs of a query read; a part with broken escapes stays."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Escapes of a query: letters, digits and ``_.-~`` stay, a space is ``+``."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, fragment or last slash.

    Parameters keep their order; names and values are decoded and encoded again,
    so that one value has one spelling.
    """
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(_path(url), r"/+$", "")
    path = F.when(path == "", _path(url)).otherwise(path)
    parts = F.filter(F.split(_query(url), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("name"),
        _decoded(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("value")))
    name = lambda x: F.lower(x["name"])
    kept = F.filter(pairs, lambda x: ~name(x).startswith(TRACKING_PREFIX) & ~name(x).isin(TRACKING_KEYS))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["name"]), F.lit("="), _encoded(x["value"]))), "&")
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), _host(url), path, tail))


def reference_key(url: Column) -> Column:
    """Identity of a cited source: a post's number, or host, path and sorted query.

    Null for homepages and for what has no host.
    """
    url = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(_host(url), r"^.*@", ""), r":\d*$", "")
    post = F.regexp_extract(_path(url), r"(?i)/+status/+([0-9]+)(?:/|$)", 1)
    path = F.regexp_replace(_path(url), r"/+$", "")
    query = F.array_join(F.array_sort(_parameters(_query(url), REFERENCE_TRACKING_KEYS)), "&")
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return (
        F.when(host == "", F.lit(None).cast("string"))
        .when(host.isin(POST_HOSTS) & (post != ""), F.concat(F.lit("x-status:"), post))
        .when(path == "", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("url:"), host, path, tail))
    )


def is_digest_title(title: Column) -> Column:
    """A column name followed by two or more items."""
    title = F.trim(F.coalesce(title, F.lit("")))
    items = F.split(F.regexp_extract(title, DIGEST_MARKER, 2), DIGEST_SEPARATORS)
    return title.rlike(DIGEST_MARKER) & (F.size(F.filter(items, lambda x: F.trim(x) != "")) >= 2)


def body_language(text: Column) -> Column:
    """zh or en by the counts of their letters, null where neither is clear."""
    cjk, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (
        F.when((cjk >= 50) | ((cjk > 0) & (cjk * 4 >= latin)), F.lit("zh"))
        .when((latin >= 200) & (cjk < 10), F.lit("en"))
    )


def cjk_ratio(text: Column) -> Column:
    """CJK characters over all that are not white space."""
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(visible > 0, F.regexp_count(text, F.lit(CJK)) / visible).otherwise(F.lit(0.0))


def event_title(value: Column) -> Column:
    """Lower-case letters, digits and ideographs alone (compatibility forms as they are)."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), ITEM_CJK, "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, wherever and however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bigrams(value: Column) -> Column:
    """Distinct two-character runs of a normalised title."""
    def runs(text: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
        return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    return once(event_title(value), runs)


def bigram_affinity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two bigram sets, 0 if both are empty."""
    def share(sets: Column) -> Column:
        union = F.size(F.array_union(sets.l, sets.r))
        return F.when(union > 0, F.size(F.array_intersect(sets.l, sets.r)) / union).otherwise(F.lit(0.0))

    return once(F.struct(left.alias("l"), right.alias("r")), share)


def contains_all_terms(haystack: Column, query: str) -> Column:
    """Every white-space separated term of ``query`` is in the text."""
    text = F.lower(F.coalesce(haystack, F.lit("")))
    condition = F.lit(True)
    for term in query.lower().split():
        condition = condition & text.contains(term)
    return condition


def term_pattern(terms: list[str]) -> str:
    """Terms on word bounds; a space in a term stands for blanks, _ or -."""
    import re

    bodies = [r"[\s_-]+".join(re.escape(part) for part in term.split()) for term in terms]
    return r"(?i)(^|[^a-z0-9])(" + "|".join(bodies) + r")([^a-z0-9]|$)"
