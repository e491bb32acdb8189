"""Run counters and summaries.

All are aggregations with partial (map-side) combine. Ordered outputs use a
bounded top-k (``orderBy().limit()`` becomes a take-ordered, no global sort);
running totals use the range-partitioned prefix sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordered_running
from .text import email_domain, sanitize_domain, sanitize_folder


def run_stats(outcomes: DataFrame) -> DataFrame:
    """A1: total, processed (reached the upsert, incl. missing email), new leads, skipped.

    As in the original counters, a message skipped for a missing email counts as
    processed *and* skipped, and a failed one as neither.
    """
    o = F.col("outcome")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(o.isin("processed", "missing_email")).alias("processed"),
        F.count_if(F.col("created")).alias("new_leads"),
        F.count_if(~o.isin("processed", "error")).alias("skipped"),
    )


def counter_rows(outcomes: DataFrame) -> DataFrame:
    """(metric, folder, domain, value): processed, created-lead and error counters by label pair, in one pass.

    An error is a message whose handling failed; the outcome table marks it ``error``.
    """
    o = F.col("outcome")
    counts = outcomes.groupBy(
        sanitize_folder("folder").alias("folder"), sanitize_domain("from_domain").alias("domain")).agg(
        F.count_if(o.isin("processed", "missing_email")).alias("emails_processed"),
        F.count_if(F.col("created")).alias("leads_created"),
        F.count_if(o == "error").alias("errors"))
    return counts.unpivot(["folder", "domain"], ["emails_processed", "leads_created", "errors"], "metric", "value").filter("value > 0")


def metrics_snapshot(outcomes: DataFrame, folder: str | None = None) -> DataFrame:
    """A2: per metric, the total and the per-domain values (ROLLUP); ``folder`` keeps one folder's counters."""
    c = counter_rows(outcomes)
    if folder is not None:
        c = c.filter(F.col("folder") == (folder.strip() or "unknown"))
    g = c.rollup("metric", "domain").agg(F.sum("value").cast("long").alias("value"), F.grouping_id().alias("_g"))
    return g.filter(F.col("metric").isNotNull()).select(
        "metric", F.when(F.col("_g") == 0, F.col("domain")).otherwise(F.lit("__total__")).alias("domain"),
        "value")


def discovered_counts(batch: DataFrame, run_ts: str) -> DataFrame:
    """Per folder, the number of messages a run discovered."""
    return batch.groupBy(sanitize_folder("folder").alias("folder")).agg(
        F.count(F.lit(1)).alias("total")).withColumn("run_ts", F.lit(run_ts).cast("timestamp"))


def discovered_gauge(runs: DataFrame) -> DataFrame:
    """A4: last value per folder (max_by over the run time)."""
    return runs.groupBy("folder").agg(F.max_by("total", "run_ts").alias("discovered"))


def run_progress(outcomes: DataFrame) -> DataFrame:
    """A5: running processed/skipped/leads counts in arrival order, one row per message.

    ``legacy_emit`` marks the messages after which the original loop emitted a
    progress event (it skipped duplicates, rejected senders and non-leads).
    """
    o = F.col("outcome")
    x = outcomes.select(
        "seq",
        F.when(o.isin("processed", "missing_email"), 1.0).otherwise(0.0).alias("p"),
        F.when(o.isin("processed", "error"), 0.0).otherwise(1.0).alias("s"),
        F.when(F.col("created"), 1.0).otherwise(0.0).alias("l"),
        o.isin("processed", "missing_email").alias("legacy_emit"),
    )
    r = ordered_running(x, ["seq"], ["p", "s", "l"], rank_col="position")
    return r.select("seq", "position", F.col("cum_p").cast("long").alias("processed"),
                    F.col("cum_s").cast("long").alias("skipped"), F.col("cum_l").cast("long").alias("leads"),
                    "legacy_emit")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Messages per outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def lead_summary(sheet: DataFrame) -> DataFrame:
    """A3: total leads and distinct companies (trimmed, lower-cased, non-empty)."""
    comp = F.lower(F.trim(F.col("company")))
    return sheet.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_distinct(F.when(comp != "", comp)).alias("unique_companies"),
    )


def top_lead_domains(sheet: DataFrame, k: int = 10, order_col: str = "seq") -> DataFrame:
    """A3: the k most frequent lead email domains; ties keep first-appearance order."""
    d = sheet.select(email_domain("email").alias("domain"), F.col(order_col).alias("_o")).filter(
        F.col("domain").isNotNull())
    return (d.groupBy("domain").agg(F.count(F.lit(1)).alias("leads"), F.min("_o").alias("first_seen"))
            .orderBy(F.desc("leads"), F.asc("first_seen")).limit(k))
