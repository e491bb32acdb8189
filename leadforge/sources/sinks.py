"""Sinks and read-side projections.

Every sink appends files; nothing rewrites a growing file per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAD_HEADERS = ["inserted_at", "email", "first_name", "last_name", "company", "phone", "subject",
                "received_at", "notes"]
EXPORT_COLUMNS = [
    "id", "email", "first_name", "last_name", "phone", "org", "source", "consent", "created_at",
    "last_message_subject", "last_message_received_at", "last_message_excerpt",
]


def prepare_headers(headers) -> list[str]:
    """Strip names, drop blanks; fall back to the default lead headers."""
    out = [str(h).strip() for h in (headers or []) if str(h).strip()]
    return out or list(LEAD_HEADERS)


def project_columns(df: DataFrame, headers, keep=()) -> DataFrame:
    """One output column per header, matched case-insensitively; missing -> null."""
    lookup = {c.lower(): c for c in df.columns}
    cols = [F.col(c) for c in keep]
    for h in prepare_headers(headers):
        src = lookup.get(h.lower())
        cols.append((F.col(src) if src else F.lit(None).cast("string")).alias(h))
    return df.select(*cols)


def contacts_export(contacts: DataFrame) -> DataFrame:
    """The 12 export columns, timestamps as ISO-8601 text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return contacts.select(
        *[F.date_format(c, iso).alias(c) if c in ("created_at", "last_message_received_at") else F.col(c)
          for c in EXPORT_COLUMNS])


def contacts_page(contacts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A stable page of contacts (ordered by creation time, then id)."""
    return contacts.orderBy("created_at", "id").offset(offset).limit(limit)


def contacts_after(contacts: DataFrame, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """S4 by key: the page behind ``after``, the (created_at, id) of the last row seen; the first page without one.

    The order is that of :func:`contacts_page`. A seek reads the rows behind the key and keeps ``limit`` of them, so a
    late page costs no more than the first; an offset sorts all rows before it.
    """
    if after is not None:
        created_at, last_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        contacts = contacts.filter((F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("id") > last_id)))
    return contacts.orderBy("created_at", "id").limit(limit)


def contacts_page_after(contacts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The page behind that of :func:`contacts_page`, by the key of its last row; nothing is behind an empty page."""
    last = contacts_page(contacts, limit, offset).agg(F.max(F.struct("created_at", "id")).alias("k")).first()["k"]  # one key
    if last is None:
        return contacts.filter(F.lit(False))
    return contacts_after(contacts, (last["created_at"], last["id"]), limit)


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_batch(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write one batch's output folder; replaying the batch overwrites the same folder."""
    df.write.mode("overwrite").format(fmt).save(path)


def events_json(events: DataFrame) -> DataFrame:
    """Events with the nested payload serialised as JSON text."""
    return events.select("seq", "contact_id", "event_type", "occurred_at",
                         F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"))


def write_evaluation(path: str, metrics: DataFrame, roc: DataFrame, pr: DataFrame) -> None:
    """Evaluation outputs — metrics (metric, value), ROC and PR points — as JSON folders."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    roc.orderBy("point").write.mode("overwrite").json(f"{path}/roc_curve")
    pr.orderBy("point").write.mode("overwrite").json(f"{path}/pr_curve")
