"""Contact upsert by exact email (U1), created/updated flag.

Arrival order decides: the first non-empty name/phone/org seen for an email
wins (an existing contact's non-empty value is kept), while the last non-empty
subject, the last received time and the last excerpt win. Within a batch this
is one ``groupBy(email)`` with ``min_by``/``max_by`` over the arrival sequence
— declarative aggregates with map-side partial aggregation, so an address that
sends a third of all mail still reduces to one partial row per task. The batch
aggregate is then merged with the previous snapshot by a full outer join on
email (one row per email on each side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL_FIELDS = ["first_name", "last_name", "phone", "org"]
CONTACT_COLUMNS = [
    "id", "email", "first_name", "last_name", "phone", "org", "source", "consent", "created_at",
    "last_message_subject", "last_message_received_at", "last_message_excerpt",
]


def contact_id(email) -> Column:
    """Deterministic contact id: SHA-256 of the email address."""
    return F.sha2(F.col(email) if isinstance(email, str) else email, 256)


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def batch_contacts(processed: DataFrame, seq: str = "seq") -> DataFrame:
    """Per email, in arrival order: first non-empty fill fields, last non-empty subject,
    last non-null received time, last excerpt, first sequence number."""
    s = F.col(seq)
    aggs = [F.min(s).alias("first_seq")]
    for f in FILL_FIELDS:
        aggs.append(F.min_by(F.col(f), F.when(_nonempty(F.col(f)), s)).alias(f))
    aggs += [
        F.max_by(F.col("subject"), F.when(_nonempty(F.col("subject")), s)).alias("last_message_subject"),
        F.max_by(F.col("received_at"), F.when(F.col("received_at").isNotNull(), s)).alias("last_message_received_at"),
        F.max_by(F.col("excerpt"), s).alias("last_message_excerpt"),
    ]
    return processed.groupBy("email").agg(*aggs)


def empty_contacts(spark) -> DataFrame:
    schema = ("id string, email string, first_name string, last_name string, phone string, org string, "
              "source string, consent boolean, created_at timestamp, last_message_subject string, "
              "last_message_received_at timestamp, last_message_excerpt string")
    return spark.createDataFrame([], schema)


def merge_contacts(prior: DataFrame, batch: DataFrame, run_ts) -> DataFrame:
    """New snapshot = prior contacts updated by the batch aggregate (full outer on email)."""
    p = prior.select([F.col(c).alias(f"p_{c}") for c in CONTACT_COLUMNS])
    j = p.join(batch, F.col("p_email") == F.col("email"), "full_outer")
    email = F.coalesce(F.col("p_email"), F.col("email"))
    fill = [F.when(_nonempty(F.col(f"p_{f}")), F.col(f"p_{f}")).otherwise(F.col(f)).alias(f) for f in FILL_FIELDS]
    return j.select(
        F.coalesce(F.col("p_id"), contact_id(email)).alias("id"),
        email.alias("email"),
        *fill,
        F.coalesce(F.col("p_source"), F.lit("email")).alias("source"),
        F.coalesce(F.col("p_consent"), F.lit(False)).alias("consent"),
        F.coalesce(F.col("p_created_at"), F.lit(run_ts).cast("timestamp")).alias("created_at"),
        F.coalesce(F.col("last_message_subject"), F.col("p_last_message_subject")).alias("last_message_subject"),
        F.coalesce(F.col("last_message_received_at"), F.col("p_last_message_received_at"))
        .alias("last_message_received_at"),
        F.when(F.col("email").isNotNull(), F.col("last_message_excerpt"))
        .otherwise(F.col("p_last_message_excerpt")).alias("last_message_excerpt"),
    ).select(*CONTACT_COLUMNS)


def created_flags(processed: DataFrame, prior: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, created) — the first processed message of an email not in the prior snapshot.

    Joins on the pair (email, first_seq), which spreads a hot address's messages
    over all partitions instead of one.
    """
    known = prior.select(F.col("email").alias("_known")).distinct()
    firsts = (batch.join(known, F.col("email") == F.col("_known"), "left_anti")
              .select("email", F.col("first_seq").alias(seq), F.lit(True).alias("created")))
    return processed.select(seq, "email").join(firsts, ["email", seq], "left").select(
        seq, F.coalesce("created", F.lit(False)).alias("created"))
