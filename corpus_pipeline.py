"""Corpus pipeline over ``documents``: each stage works on what the one before kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``:

1. ``toxicity``: rows whose score reaches their language's threshold go;
2. ``exact_dedup``: of equal texts the row with the smallest id stays;
3. ``ngram_join``: of each near-duplicate group the row with the smallest id stays;
4. ``decontamination``: rows that hold a test item go;
5. ``packing``: the rest becomes sequences; one row per piece.

Defined cases are those of the operators: null texts count as empty, and an
empty text stays once (its copies go in stage 2), is no near-duplicate, holds no
test item and packs as its end id alone; an empty table gives an empty result;
other columns are handed through up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadforge.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from leadforge.llm.tables import materialise, read_table

#: the trained classifier and the tokenizer's ids have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs, exact_dedup.open_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
