"""Substring dedup by line and sentence hashing.

Units are the lines of a text, its sentences (a line's end ends a sentence),
and runs of sentences for what is short: the shortest run of ``RUN_WORDS`` or
more that starts at a sentence and the shortest that ends there, across lines.
Only runs with a short sentence are units, as long sentences are units alone.
So a repeated passage of whole sentences goes as a whole from ``RUN_WORDS`` on,
wherever it is pasted: a short sentence of it ends a run inside the passage, or
one from the passage's start covers it.  A unit is normalised (lower case,
white space collapsed), hashed to 128 bits and grouped over all documents; one
sentence and a run of the same words have the same digest.  The occurrence in
the first row stays, within a row the first one; all others are removed, and
the result keeps their offsets in the original text.  Rows rank by document id,
null ids last, and those that share an id by their place in the input.  Sentences
and runs are reported only where their line stays; runs may overlap.

Lengths are in words; scripts that don't space words count two letters as one,
and any text 16 characters as one at least.  Lines, sentences and runs that
are shorter than their bound, a parameter of each call, are ordinary language and
stay.  Digests are summed by key before they meet, and
the join that finds the removed occurrences has plain exchanges on both sides,
so adaptive execution splits a line that a third of all documents carry.

Defined results: null and empty texts have no units; rows that repeat a
document id, a text or both are rows of their own, so all units of a second
copy are removed; texts are read whole at any length; an empty table gives an
empty result; extra columns are never read, and ``without_repeats`` passes
them through, but for columns named like the two it adds, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from xxhash import xxh3_128_intdigest

from .storage import bounded_batches, work_folder, written

LINE_WORDS = 5
SENTENCE_WORDS = 8
RUN_WORDS = 16
LINE, SENTENCE, RUN = range(3)
_SENTENCE_END = re.compile(r"[.!?]+\s+|[。！？｡]+\s*")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SIGN = 1 << 63
_WRAP = 1 << 64


def _signed(value: int) -> int:
    return value - _WRAP if value >= _SIGN else value


def _size(words: list[str], joined: str) -> int:
    """Length in words, also of text that has no spaces."""
    n = max(len(words), len(joined) // 16)
    return n if joined.isascii() else max(n, len(_UNSPACED.findall(joined)) // 2)


def _digest(joined: str) -> tuple[int, int]:
    digest = xxh3_128_intdigest(joined)
    return _signed(digest >> 64), _signed(digest % _WRAP)


class Bounds(NamedTuple):
    """Least words of a unit, by kind."""

    line: int = LINE_WORDS
    sentence: int = SENTENCE_WORDS
    run: int = RUN_WORDS


def _runs(sentences: list[tuple[int, int, int, int, str]], bounds: Bounds) -> set[tuple[int, int]]:
    """First and last sentence of each run that is a unit."""
    sizes = [s[3] for s in sentences]
    before = list(accumulate(sizes, initial=0))
    short = list(accumulate((n < bounds.sentence for n in sizes), initial=0))
    found, last, first = set(), 0, 0
    for i, n in enumerate(sizes):
        while last < len(sizes) and before[last + 1] - before[i] < bounds.run:
            last += 1
        while before[i + 1] - before[first + 1] >= bounds.run:
            first += 1
        if n < bounds.run:
            if last < len(sizes):
                found.add((i, last))
            if before[i + 1] - before[first] >= bounds.run:
                found.add((first, i))
    return {(i, j) for i, j in found if short[j + 1] > short[i]}


def units_of(text: str, bounds: Bounds = Bounds()) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, kind, line number or -1, digest high, digest low) of each unit."""
    found, sentences, start = [], [], 0
    for number, line in enumerate(text.split("\n")):
        words = line.lower().split()
        joined = " ".join(words)
        if words and _size(words, joined) >= bounds.line:
            found.append((start, start + len(line), LINE, number, *_digest(joined)))
        cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = line[a:b].lower().split()
            if own:
                joined = " ".join(own)
                stop = start + a + len(line[a:b].rstrip())
                sentences.append((start + a, stop, number, _size(own, joined), joined))
        start += len(line) + 1
    for a, b, number, size, joined in sentences:
        if size >= bounds.sentence:
            found.append((a, b, SENTENCE, number, *_digest("s " + joined)))
    for i, j in sorted(_runs(sentences, bounds)):
        line = sentences[i][2] if sentences[i][2] == sentences[j][2] else -1
        joined = " ".join(s[4] for s in sentences[i : j + 1])
        found.append((sentences[i][0], sentences[j][1], RUN, line, *_digest("s " + joined)))
    return found


_UNITS = "start int, stop int, kind int, line int, hi long, lo long, nth int"


def _unit_rows(bounds: Bounds):
    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                owners, columns = [], [[] for _ in range(7)]
                for i, text in enumerate(part.column(2).to_pylist()):
                    seen: dict[tuple[int, int], int] = {}
                    for unit in units_of(text, bounds) if text else ():
                        key = unit[4:]
                        seen[key] = nth = seen.get(key, -1) + 1
                        owners.append(i)
                        for column, value in zip(columns, (*unit, nth), strict=True):
                            column.append(value)
                own = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own),
                     *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["row", "doc_id", "start", "stop", "kind", "line", "hi", "lo", "nth"],
                )

    return unit_rows


def _removed(rows: DataFrame, bounds: Bounds, folder: str) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, start, stop, kind, first_doc_id of what goes."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    units = written(rows.mapInArrow(_unit_rows(bounds), f"row long, doc_id {kind}, {_UNITS}"), f"{folder}/units")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    again = written(
        units.groupBy("hi", "lo").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("hi", "lo", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row")),
        f"{folder}/again",
    )
    gone = written(
        units.join(again, ["hi", "lo"])
        .where((F.col("nth") > 0) | (F.col("row") != F.col("first_row")))
        .select("row", "doc_id", "line", "start", "stop", "kind", "first_doc_id"),
        f"{folder}/gone",
    )
    lines = gone.where(F.col("kind") == LINE).select("row", "line").distinct()
    inside = gone.where(F.col("kind") != LINE).join(lines, ["row", "line"], "left_anti")
    return gone.where(F.col("kind") == LINE).unionByName(inside).drop("line")


def repeated_units(docs: DataFrame, **bounds: int) -> DataFrame:
    """One row for each removed unit: doc_id, start, stop, unit, first_doc_id."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")
    )
    unit = F.when(F.col("kind") == LINE, "line").when(F.col("kind") == SENTENCE, "sentence").otherwise("run")
    return _removed(rows, Bounds(**bounds), work_folder(docs.sparkSession, "units")).select(
        "doc_id", "start", "stop", unit.alias("unit"), "first_doc_id"
    )


def without_repeats(docs: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` with ``removed_spans`` of the original and the ``clean_text`` that is left."""
    folder = work_folder(docs.sparkSession, "units")
    passed = [c for c in docs.columns if c not in ("removed_spans", "clean_text")]
    whole = F.struct(*[F.col(f"`{c}`") for c in passed]).alias("whole")
    rows = written(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"), whole),
        f"{folder}/rows",
    )
    spans = (
        _removed(rows.select("row", "doc_id", "text"), Bounds(**bounds), folder)
        .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed_spans"))
    )  # a row's own units
    joined = rows.join(spans, "row", "left").select("whole", "text", "removed_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, at = [], 0
                for span in own or ():
                    kept.append(text[at : span["start"]])
                    at = max(at, span["stop"])
                out.append(None if text is None else "".join(kept) + text[at:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["whole", "removed_spans", "clean_text"]
            )

    schema = StructType([joined.schema["whole"], joined.schema["removed_spans"], StructField("clean_text", StringType())])
    return joined.mapInArrow(cut, schema).select("whole.*", "removed_spans", "clean_text")
