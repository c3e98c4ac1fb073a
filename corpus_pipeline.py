"""From raw documents to token files: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes what a stage returns
as Parquet in the shared folder and reads it again for the next one, so a lost
executor never reaches back beyond a stage.

Defined results: null and empty texts, and texts without a letter, go in the
first stage; null ids rank last and rows that repeat an id and a text are one
group in the second; a null source is a source of its own in the fourth; empty
tables give an empty result; whole texts are read at any length; columns beside
those of ``documents`` pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import table, tokenizer_path
from tidewire.llm.decontamination import clean
from tidewire.llm.language_id import accepted
from tidewire.llm.mixing import mixed
from tidewire.llm.near_dedup import representatives
from tidewire.llm.storage import work_folder, written
from tidewire.llm.token_files import token_id_output
from tidewire.session import ensure_importable


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject."""
    ensure_importable(spark)
    return accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, 0.8 or more."""
    ensure_importable(spark)
    return representatives(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what they hold."""
    ensure_importable(spark)
    return token_id_output(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Language ID, MinHash and the tokenizer have no SQL form; the chain is tested
#: against slow twins of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
