"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table of one row per distinct text, ``(digest, keep_id, added, batch)``,
bucketed and sorted by ``digest``. A batch is handled in four steps:

1. texts are normalised and digested once; only ``(doc_id, digest)`` goes on;
2. copies inside the batch meet in a partially aggregated ``groupBy(digest)``,
   so a digest that holds a third of all rows costs one row per task;
3. a sort-merge anti-join against the index leaves the digests it lacks (the
   index side is read in its buckets, already sorted: it does not shuffle);
4. these are appended to the index.

The index remembers which batch brought a text. A batch that is run again under the
same name, after a failure say, finds its texts there as its own: it keeps the same
rows and appends nothing.

Rows get their keeper back through a join whose two sides are both freshly
shuffled narrow tables, so that adaptive execution splits a hot digest.

Defined cases: a null text equals an empty one; texts are equal when they are
identical after each run of ASCII white space became one space; among equal
rows the smallest id stays (a row whose text the index already holds never
does); rows with the same id and text count as separate rows, and all those
that carry the kept id stay; a null id is never the keeper unless all are
null; an empty table gives an empty result. Columns other than the id and
text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .keep import drop_losers
from .tables import materialise

SPACES = r"[\x20\x09-\x0D]+"
INDEX_SCHEMA = "digest binary, keep_id bigint, added bigint, batch string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A saved table of known digests, bucketed and sorted by digest.

    ``path`` names its folder in shared storage; the table is registered in the
    session's catalogue under ``name`` when it is opened.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lacking(self, firsts: DataFrame) -> DataFrame:
        """Rows of ``firsts`` (one per digest) whose digest the index lacks: sort-merge anti-join."""
        return firsts.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Append ``(digest, keep_id, added, batch)`` rows; one task and file per bucket, sorted by digest."""
        (new.select("digest", "keep_id", "added", "batch")
            .repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """The index in ``path``, or a new one in the shared checkpoint folder."""
    count = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, path or scratch_path(spark, "digest-index"), buckets=count)


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the id that the index holds for the text, after the batch's new
    texts were appended; ``group_size`` counts the rows of this batch with the
    text; ``kept`` marks the rows that stay: those that brought a new text. ``batch`` names
    the batch; without a name it is a new one.
    """
    batch = batch or uuid.uuid4().hex
    digested = materialise(
        docs.select(docs[id_col].cast("bigint").alias("doc_id"), digest_of(docs[text_col]).alias("digest")),
        "digests")
    firsts = materialise(
        digested.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("added")),
        "digest-firsts")
    new = materialise(index.lacking(firsts).withColumn("batch", F.lit(batch)), "digests-new")
    index.append(new)
    # the keepers of this batch's texts, with whether this batch brought them
    known = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
    keepers = materialise(firsts.select("digest", F.col("added").alias("group_size")).join(known, "digest"), "digest-keepers")
    return digested.join(keepers, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that :func:`dedup` keeps, with their own columns.

    Only rows whose text occurs more than once, or is known to the index, are
    shuffled; of repeated rows (same id, equal texts) one stays.
    """
    decided = dedup(docs, index).filter((F.col("group_size") > 1) | ~F.col("kept"))
    return drop_losers(docs, decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays")),
                       lambda rows: rows.withColumn("text_sha256", F.lower(F.hex(digest_of(F.col("text"))))))


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Dedup ``docs`` against a new index in the shared checkpoint folder."""
    return dedup(docs, open_index(spark))
