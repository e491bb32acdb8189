"""Sender allow-list (F1), seen filter (F2), in-batch dedup (F3) and outcome routing.

Design for scale:
* The allow-list is configuration (a handful of domains): a literal ``IN``.
* The ledger of processed messages grows without bound, so it is never
  broadcast by hint; joins against it are plain equi-joins that AQE turns into
  broadcasts only when the runtime size allows.
* Key bookkeeping runs on a narrow projection (seq, ids); wide message rows
  are joined back once, by ``seq``.
* First-occurrence dedup never puts one key's rows into one task: it
  aggregates ``min(seq)`` per key (map-side partial aggregation absorbs a hot
  key) and joins back on the pair ``(key, seq)``, which hashes a hot key's rows
  across all partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import connected
from .text import _c, address_of, strip_ws

MAX_COMPONENT = 500_000  # key pairs of one component that a task settles


def sender_check(from_header, allowed_domains=None) -> tuple[Column, Column]:
    """(allowed, reason). Invalid address rejects; an empty list allows every domain."""
    raw = F.coalesce(_c(from_header), F.lit(""))
    addr = address_of(raw)
    valid = (addr != "") & addr.contains("@")
    domain = F.lower(F.substring_index(addr, "@", -1))
    allowed_set = sorted({d.strip().lower() for d in (allowed_domains or []) if d and d.strip()})
    in_list = F.lit(True) if not allowed_set else domain.isin(allowed_set)
    allowed = valid & in_list
    reason = (
        F.when(~valid, F.concat(F.lit("Invalid sender address: '"), raw, F.lit("'")))
        .when(~in_list, F.concat(F.lit("Sender domain not allowed: "), domain))
    )
    return allowed, reason


def ledger_key(message_id, imap_uid) -> Column:
    """S9 key: the Message-ID, else ``uid:<uid>``."""
    mid = F.nullif(strip_ws(_c(message_id)), F.lit(""))
    return F.coalesce(mid, F.concat(F.lit("uid:"), _c(imap_uid)))


def seen_flags(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """F2 as flags on a narrow frame: (seq, seen_by_id, seen_by_uid).

    Two equi-joins on distinct ledger keys — never one OR-join, which would
    become a nested loop.
    """
    keys = batch.select(
        "seq",
        F.nullif(strip_ws("message_id"), F.lit("")).alias("mid"),
        F.col("imap_uid").alias("uid"),
    )
    by_id = ledger.select(F.col("message_id").alias("mid")).distinct().withColumn("seen_by_id", F.lit(True))
    by_uid = (
        ledger.filter(F.col("imap_uid").isNotNull())
        .select(F.col("imap_uid").alias("uid")).distinct().withColumn("seen_by_uid", F.lit(True))
    )
    # rows without an id or uid cannot match: they do not meet in the join's null partition
    has_id = keys.filter(F.col("mid").isNotNull()).join(by_id, "mid", "left")
    after_id = has_id.unionByName(keys.filter(F.col("mid").isNull()), allowMissingColumns=True)
    has_uid = after_id.filter(F.col("uid").isNotNull()).join(by_uid, "uid", "left")
    return (
        has_uid.unionByName(after_id.filter(F.col("uid").isNull()), allowMissingColumns=True)
        .select(
            "seq", "mid", "uid",
            F.coalesce("seen_by_id", F.lit(False)).alias("seen_by_id"),
            F.coalesce("seen_by_uid", F.lit(False)).alias("seen_by_uid"),
        )
    )


def first_occurrence(df: DataFrame, key: str, order: str = "seq", flag: str = "is_first") -> DataFrame:
    """Flag the lowest ``order`` row per non-null ``key``; rows without a key are always first."""
    firsts = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key).agg(F.min(order).alias(order))
        .withColumn(flag, F.lit(True))
    )
    keyed = df.filter(F.col(key).isNotNull()).join(firsts, [key, order], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return keyed.unionByName(df.filter(F.col(key).isNull()).withColumn(flag, F.lit(True)))


def _first_by_both(open_rows: DataFrame) -> DataFrame:
    """Rows that are the first of their id and of their uid; a missing key never stands in the way."""
    by_mid = first_occurrence(open_rows, "mid", flag="first_mid").filter("first_mid").select("seq")
    by_uid = first_occurrence(open_rows, "uid", flag="first_uid").filter("first_uid")
    return by_uid.join(by_mid, "seq").select("seq", "mid", "uid")


def _close(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (rows first by both keys, open rows that share no key with them)."""
    kept = _first_by_both(open_rows).checkpoint()
    left = (open_rows.join(kept.select("seq"), "seq", "left_anti")
            .join(kept.select("mid").filter("mid is not null"), "mid", "left_anti")
            .join(kept.select("uid").filter("uid is not null"), "uid", "left_anti")
            .select("seq", "mid", "uid").checkpoint())
    return kept.select("seq"), left


def _in_order(group: pa.Table) -> pa.Table:
    """The rows of one component that stay, message by message."""
    rows = sorted(zip(*[group[c].to_pylist() for c in ("seq", "mid", "uid")]))
    mids, uids, stay = set(), set(), []
    for seq, mid, uid in rows:
        if mid not in mids and uid not in uids:
            stay.append(seq)
            mids |= {mid} - {None}
            uids |= {uid} - {None}
    return pa.table({"seq": pa.array(stay, pa.int64())})


def _by_component(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay in the components of ``MAX_COMPONENT`` key pairs at most, open rows of larger ones).

    Rows with equal keys count by their first alone: the others are duplicates, whether it stays or not.
    """
    pairs = open_rows.groupBy("mid", "uid").agg(F.min("seq").cast("long").alias("seq")).checkpoint()
    mid, uid = F.concat(F.lit("m"), F.col("mid")), F.concat(F.lit("u"), F.col("uid"))
    named = pairs.withColumn("node", F.coalesce(mid, uid))
    roots = connected(named.select(F.col("node").alias("u"), F.coalesce(uid, mid).alias("v"))).checkpoint()
    sized = named.join(roots, "node")
    small = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("small", F.col("n") <= MAX_COMPONENT)
    placed = sized.join(small, "root")
    stay = placed.filter("small").select("root", "seq", "mid", "uid").groupBy("root").applyInArrow(_in_order, "seq long")
    return stay.checkpoint(), placed.filter(~F.col("small")).select("seq", "mid", "uid").checkpoint()


def duplicate_flags(batch: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """F2 + F3 on the narrow key frame: (seq, duplicate).

    A message is a duplicate when its id or uid is already in the ledger, or an
    earlier message of the batch (that was not itself a duplicate) shares its
    id or uid: exactly the message-by-message order. A first round keeps the rows
    that are first by both keys and closes all rows that share a key with them;
    that is everything unless a uid carries several ids or the reverse. The rest
    falls into connected components of keys, each settled in message order in one
    task, whatever the length of its chains. A component of more than ``MAX_COMPONENT``
    key pairs goes on in rounds instead, so no task holds more. Narrow rows only.
    """
    if ledger is not None:
        keys = seen_flags(batch, ledger)
        keys = keys.withColumn("seen", F.col("seen_by_id") | F.col("seen_by_uid")).select("seq", "mid", "uid", "seen")
    else:
        keys = batch.select(
            "seq",
            F.nullif(strip_ws("message_id"), F.lit("")).alias("mid"),
            F.col("imap_uid").alias("uid"),
        ).withColumn("seen", F.lit(False))
    keys = keys.checkpoint()
    stay, left = _close(keys.filter(~F.col("seen")).drop("seen"))
    if not left.isEmpty():
        more, left = _by_component(left)
        stay = stay.unionByName(more)
    while not left.isEmpty():
        more, left = _close(left)
        stay = stay.unionByName(more)
    return keys.select("seq").join(stay.withColumn("kept", F.lit(True)), "seq", "left").select(
        "seq", F.col("kept").isNull().alias("duplicate"))


def ambiguous_key_groups(batch: DataFrame) -> DataFrame:
    """Keys in conflict: one uid with several distinct ids or one id with several uids.

    The dedup resolves them in message order; a strict run stops at them instead.
    """
    k = batch.select(F.nullif(strip_ws("message_id"), F.lit("")).alias("mid"), F.col("imap_uid").alias("uid"))
    a = k.filter(F.col("mid").isNotNull()).groupBy("uid").agg(F.countDistinct("mid").alias("n")).filter("n > 1")
    b = k.filter(F.col("mid").isNotNull()).groupBy("mid").agg(F.countDistinct("uid").alias("n")).filter("n > 1")
    return a.select(F.lit("uid").alias("kind"), F.col("uid").alias("key"), "n").unionByName(
        b.select(F.lit("message_id").alias("kind"), F.col("mid").alias("key"), "n")
    )


def route_outcome(duplicate, allowed, is_lead, email) -> tuple[Column, Column]:
    """first match wins — duplicate, not_allowed, not_lead, missing_email, processed."""
    outcome = (
        F.when(_c(duplicate), F.lit("duplicate"))
        .when(~_c(allowed), F.lit("not_allowed"))
        .when(~_c(is_lead), F.lit("not_lead"))
        .when(_c(email).isNull(), F.lit("missing_email"))
        .otherwise(F.lit("processed"))
    )
    status = F.when(outcome == "processed", F.lit("processed")).otherwise(F.lit("skipped"))
    return outcome, status
