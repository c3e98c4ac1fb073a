"""HTML bodies as blocks, in Arrow batches: the one place where text is parsed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as K

from tidewire.session import bounded_batches

BATCH_ROWS = 200
PART_CHARACTERS = 1 << 22
HEADINGS = {f"h{i}": i for i in range(1, 7)}
SKIPPED = {"script", "style", "nav", "footer", "aside", "form", "noscript", "svg"}
REGIONS = ("article", "main")
REGION_TAGS = {name: re.compile(
    r"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(script|style)\b[^>]*+(?:\Z|>(?<!/>).*?(?:</\1\s*+>|\Z))"
    rf"|(?P<end>/{name}\s*+>)|(?P<begin>{name}(?=[\s/>])[^>]*+(?:>(?<!/>)|\Z)))") for name in REGIONS}
LEAST_REGION = 200


class Blocks(HTMLParser):
    """Collects paragraphs, headings, code, lists, quotes, images and links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.kind, self.level = "paragraph", 0
        self.skip = 0
        self.links: list[str] = []

    def close_block(self) -> None:
        text = "".join(self.text) if self.kind == "code" else " ".join("".join(self.text).split())
        if text.strip():
            block = {"type": self.kind, "text": text}
            if self.kind == "heading":
                block["level"] = self.level
            if self.links:
                block["links"] = self.links
            self.blocks.append(block)
        self.text, self.links, self.kind = [], [], "paragraph"

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in HEADINGS:
            self.close_block()
            self.kind, self.level = "heading", HEADINGS[tag]
        elif tag in ("p", "div", "section", "article", "main", "tr", "ul", "ol", "table"):
            self.close_block()
        elif tag in ("li", "blockquote", "pre"):
            self.close_block()
            self.kind = {"li": "list_item", "blockquote": "quote", "pre": "code"}[tag]
        elif tag == "br":
            self.text.append("\n")
        elif tag == "img" and given.get("src") and not self.skip:
            self.close_block()
            self.blocks.append({"type": "image", "url": given["src"], "alt": given.get("alt") or ""})
        elif tag == "a" and given.get("href"):
            self.links.append(given["href"])

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in HEADINGS or tag in ("p", "div", "section", "article", "main", "li", "blockquote", "pre", "tr"):
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def blocks_of(html: str | None) -> list[dict]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.blocks


def elements(html: str, name: str) -> list[str]:
    """Contents of the outermost elements of a name, each to its own end tag.

    Tags in comments and scripts don't count. An element with inner ends but none of its own
    runs to the end of the page; one without any end is none.
    """
    found, depth, start, ended = [], 0, 0, False
    for tag in REGION_TAGS[name].finditer(html):
        if tag["end"] and depth:
            depth, ended = depth - 1, True
            if not depth:
                found.append(html[start:tag.start()])
        elif tag["begin"]:
            if not depth:
                start, ended = tag.end(), False
            depth += 1
    return [*found, html[start:]] if depth and ended else found


def main_region(html: str | None) -> str:
    """The longest article or main element of enough text, else the whole."""
    for name in REGIONS:
        found = elements(html or "", name)
        best = max(found, key=lambda x: len(re.sub(r"<[^>]+>", "", x)), default="")
        if len(re.sub(r"<[^>]+>", "", best).strip()) >= LEAST_REGION:
            return best
    return html or ""


def read_page(html: str | None) -> tuple[str, list[str], str, list[str]]:
    """Blocks (JSON), paragraphs, text and links of the main region."""
    own = blocks_of(main_region(html))
    said = [b["text"] for b in own if "text" in b]
    return json.dumps(own, ensure_ascii=False), said, "\n".join(said), [u for b in own for u in b.get("links", [])]


def parts(pdf: pd.DataFrame, html: str, characters: int) -> Iterator[pd.DataFrame]:
    """Rows in order, in parts of about so many characters of pages, of one page at least."""
    lengths = pd.Series([len(h or "") for h in pdf[html]], index=pdf.index, dtype="int64")
    for _, part in pdf.groupby((lengths.cumsum() // characters).to_numpy()):
        yield part


def extract_content(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """``pages`` with blocks (JSON), paragraphs, text and links of the main region.

    A page's blocks have no limit in number. A worker holds ``BATCH_ROWS`` whole pages at a
    time, whatever the size of the table, and what was read of ``PART_CHARACTERS`` of them.
    """
    bounded_batches(pages.sparkSession, BATCH_ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in parts(pdf, html, PART_CHARACTERS):
                blocks, paragraphs, body, links = zip(*map(read_page, part[html]))
                yield part.assign(blocks=blocks, paragraphs=paragraphs, body=body, links=links)

    extra = [K.StructField("blocks", K.StringType()), K.StructField("paragraphs", K.ArrayType(K.StringType())),
             K.StructField("body", K.StringType()), K.StructField("links", K.ArrayType(K.StringType()))]
    return pages.mapInPandas(run, K.StructType([*pages.schema.fields, *extra]))


def cited_keys(content: DataFrame) -> DataFrame:
    """Reference keys of the posts that a body links to."""
    from pyspark.sql import functions as F

    from tidewire.functions.text import reference_key

    keys = content.withColumn("link", F.explode("links")).withColumn("key", reference_key(F.col("link")))
    return keys.where(F.col("key").startswith("x-status:")).drop("link").dropDuplicates([c for c in ("page_id", "article_id", "key") if c in keys.columns])


def prefer_full_page(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """A page's body in place of the feed's, where it was read."""
    from pyspark.sql import functions as F

    own = pages.select("source_url", F.col("body").alias("_body"))
    return articles.join(own, "source_url", "left").withColumn(
        "content", F.coalesce(F.nullif(F.trim("_body"), F.lit("")), F.col("content"))).drop("_body")
