"""Dropping rows by a table of decided texts without shuffling the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import materialise


def drop_losers(docs: DataFrame, decided: DataFrame, keyed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` without the rows that ``decided`` (``doc_id, stays`` and the key of a text) drops.

    An id may stand for several texts, and rows may have none: a row is decided by
    its id and its text's key together. ``keyed`` adds the key's columns to rows
    with a ``text``; without it the id alone decides. ``decided`` has one row for
    each id and key. Rows that it lacks stay as they are; of repeated rows (same
    id and key) with a deciding id one stays. A Bloom filter of the decided ids
    lets all other rows pass without a shuffle; other columns are handed through,
    whatever their names.
    """
    key = [c for c in decided.columns if c not in ("doc_id", "stays")]
    decided = materialise(decided.select(F.col("doc_id").alias("decided_id"), *[F.col(c).alias(f"decided_{c}") for c in key], "stays"), "decided")
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    flagged = bloom.possible(rows, F.col("id"), decided, F.col("decided_id"), decided.count())
    passed = flagged.filter(~F.col("_possible")).select("row.*")
    likely = flagged.filter("_possible").drop("_possible")
    if keyed is not None:
        likely = keyed(likely)
    same = F.col("id").eqNullSafe(F.col("decided_id"))
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"decided_{c}"))
    suspects = likely.join(decided, same, "left")
    untouched = suspects.filter(F.col("stays").isNull()).select("row.*")
    winners = suspects.filter("stays")
    if not key:
        key = ["digest"]
        winners = winners.withColumn("digest", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return passed.unionByName(untouched).unionByName(winners.dropDuplicates(["id", *key]).select("row.*"))
