"""One ingestion run as a lazy Spark plan: batch -> outcomes, contacts, ledger, events, leads.

Stages, cheapest first (duplicates and refused senders pass the scorer with null
scores, unscored):

1. duplicate flags on the narrow key frame (ledger anti-joins + in-batch
   first occurrence), joined back to the wide batch once by ``seq``;
2. sender allow-list;
3. lead score (rules, classifier or both, per strategy);
4. contact fields (only for leads);
5. outcome routing, then the contact upsert and the sink rows.

A batch may carry a column ``fault``, the reason why a mail could not be read: such a
row gets the outcome ``error`` and nothing else. It is in no ledger, so a good copy of
the mail is taken when it comes, in this batch or a later one; the run goes on.

``run_batch`` writes every output under one ``batch_id`` folder; replaying a
batch rewrites the same folder, so ledger, events and contacts stay consistent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import ensemble as ens
from ..operators import extract, nb, routing, rules, text, upsert
from ..sources.tables import headers_map

LEDGER_SCHEMA = "message_id string, imap_uid string"


@dataclass
class RunConfig:
    allowed_domains: list[str] = field(default_factory=list)
    strategy: str = "rule_based"                   # rule_based | ml | hybrid
    lexicon: rules.Lexicon = field(default_factory=lambda: rules.DEFAULT_LEXICON)
    model: nb.NBModel | None = None
    ml_threshold: float = L.ML_THRESHOLD
    run_ts: str = "2024-02-01 00:00:00"
    check_keys: bool = False


@dataclass
class RunResult:
    outcomes: DataFrame
    contacts: DataFrame
    ledger: DataFrame
    events: DataFrame
    new_leads: DataFrame


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def score_leads(df: DataFrame, cfg: RunConfig, live: Column | None = None) -> DataFrame:
    """Add (is_lead, lead_score, confidence) per the runner strategy.

    Rows that are not ``live`` get nulls and are not scored; the wide batch is read once for both.
    """
    live = F.lit(True) if live is None else live
    scored = df.withColumn("rule_score", F.when(live, rules.rule_score("headers", "body", cfg.lexicon)))
    use_ml = cfg.strategy in ("ml", "hybrid") and cfg.model is not None
    if use_ml:
        # score a narrow (seq, text) frame; the result is hash-partitioned on seq like the batch
        narrow = df.filter(live).select("seq", text.combine_text("subject", "body").alias("_text"))
        ml_scores = nb.nb_score(narrow, cfg.model, "seq", "_text", out="ml_score")
        scored = scored.join(ml_scores, "seq", "left")
    ml = F.col("ml_score") if use_ml else F.lit(None).cast("double")
    r = ens.runner_strategy(ml, "rule_score", cfg.strategy, ml_available=use_ml,
                            ml_threshold=cfg.ml_threshold, rule_threshold=cfg.lexicon.threshold)
    return scored.withColumn("_lead", F.when(live, r)).select(
        "*", F.col("_lead.is_lead").alias("is_lead"), F.col("_lead.score").alias("lead_score"),
        F.col("_lead.confidence").alias("confidence")).drop("_lead")


def run(batch: DataFrame, ledger: DataFrame, prior_contacts: DataFrame, cfg: RunConfig,
        cut=None, changed_only: bool = False) -> RunResult:
    """Plan one run over ``batch`` (messages schema) against the prior ledger and contacts.

    With ``changed_only`` the result's contacts are the rows this batch touched, not the full snapshot.

    ``cut`` (e.g. ``lambda df: df.checkpoint()`` or a write-then-read into the
    batch folder) is applied to the per-message outcomes, so every output of the
    run is derived from one materialised table instead of re-planning the scoring
    and extraction for each output.
    """
    if cfg.check_keys and ambiguous_keys(batch):
        raise ValueError("batch has a uid with several Message-IDs (or the reverse)")
    has_fault = "fault" in batch.columns
    good = F.col("fault").isNull() if has_fault else F.lit(True)
    keyed = batch.select("seq", *[F.when(good, F.col(c)).alias(c) for c in ("message_id", "imap_uid")]) if has_fault else batch
    dup = routing.duplicate_flags(keyed, ledger)
    b = batch.join(dup, "seq", "inner")
    allowed, reason = routing.sender_check("from_header", cfg.allowed_domains)
    b = b.select(
        "*",
        F.nullif(text.strip_ws("message_id"), F.lit("")).alias("mid"),
        text.sender_domain("from_header").alias("from_domain"),
        F.coalesce(allowed & good, F.lit(False)).alias("allowed"), reason.alias("allow_reason"),
        headers_map(b).alias("headers"),
        F.nullif(F.col("subject"), F.lit("")).alias("subject_h"),
    )
    live = ~F.col("duplicate") & F.col("allowed")
    scored = score_leads(b, cfg, live)
    # extraction only for messages classified as leads; the others have no lead flag
    fields = F.when(F.col("is_lead"), extract.parse_contact("body", "headers"))
    p = scored.withColumn("fields", fields)
    outcome, status = routing.route_outcome("duplicate", "allowed", "is_lead", F.col("fields.email"))
    if has_fault:
        outcome, status = F.when(~good, F.lit("error")).otherwise(outcome), F.when(~good, F.lit("error")).otherwise(status)
    p = p.withColumn("outcome", outcome).withColumn("status", status)
    reason_col = (
        F.when(F.col("outcome") == "error", F.col("fault") if has_fault else F.lit(None).cast("string")).when(F.col("outcome") == "duplicate", F.lit("duplicate"))
        .when(F.col("outcome") == "not_allowed", F.col("allow_reason"))
        .when(F.col("outcome") == "not_lead",
              F.format_string("Missing lead keywords (score=%.2f, conf=%s)", F.col("lead_score"), F.col("confidence")))
        .when(F.col("outcome") == "missing_email", F.lit("missing_email"))
    )
    reached = F.col("outcome").isin("processed", "missing_email")
    outcomes = p.select(
        "seq", "folder", F.col("mid").alias("message_id"), "imap_uid", "from_header", "from_domain",
        "outcome", "status",
        reason_col.alias("reason"),
        F.when(~F.col("duplicate") & F.col("allowed"), F.col("lead_score")).alias("lead_score"),
        F.when(~F.col("duplicate") & F.col("allowed"), F.col("confidence")).alias("confidence"),
        F.col("fields.email").alias("email"), F.col("fields.first_name").alias("first_name"),
        F.col("fields.last_name").alias("last_name"), F.col("fields.phone").alias("phone"),
        F.col("fields.org").alias("org"),
        F.col("subject_h").alias("subject"),
        F.when(reached, text.received_at("date_header")).alias("received_at"),
        # its Python step runs for every row: only mail that is kept brings its body there
        text.excerpt(F.when(F.col("outcome") == "processed", F.col("body"))).alias("excerpt"),
        F.map_filter("headers", lambda name, _: ~name.isin("Message-ID", "Subject")).alias("other_headers"),
        "date_header",
    )
    if cut is not None:
        outcomes = cut(outcomes)
    processed = outcomes.filter(F.col("outcome") == "processed")
    agg = upsert.batch_contacts(processed)
    if changed_only:
        prior_contacts = prior_contacts.join(agg.select("email"), "email", "left_semi")
    contacts = upsert.merge_contacts(prior_contacts, agg, cfg.run_ts)
    created = upsert.created_flags(processed, prior_contacts, agg)
    outcomes = outcomes.join(created, "seq", "left").withColumn(
        "created", F.coalesce("created", F.lit(False)))

    ledger_rows = outcomes.filter(~F.col("outcome").isin("duplicate", "error")).select(
        F.coalesce(F.col("message_id"), F.concat(F.lit("uid:"), F.col("imap_uid")),
                   F.when(F.col("outcome") == "processed", upsert.contact_id(F.col("email"))))
        .alias("message_id"),
        "imap_uid", "seq",
    ).filter(F.col("message_id").isNotNull())

    events = processed.select(
        "seq",
        upsert.contact_id(F.col("email")).alias("contact_id"),
        F.lit("email_inbound").alias("event_type"),
        F.lit(cfg.run_ts).cast("timestamp").alias("occurred_at"),
        F.struct(
            F.map_concat(F.create_map(F.lit("Message-ID"), F.col("message_id"), F.lit("Subject"), F.col("subject")),
                         F.col("other_headers")).alias("headers"),
            F.struct("first_name", "last_name", "email", "phone", "org").alias("extracted"),
            text.received_at_iso_local("date_header").alias("received_at"),
            F.col("excerpt").alias("body_excerpt"),
        ).alias("payload"),
    )
    new_leads = outcomes.filter("created").select(
        "seq",
        F.lit(cfg.run_ts).cast("timestamp").alias("inserted_at"),
        "email", "first_name", "last_name", F.col("org").alias("company"), "phone", "subject",
        "received_at", F.col("excerpt").alias("notes"),
    )
    return RunResult(outcomes.drop("date_header", "from_header", "other_headers"), contacts, ledger_rows, events, new_leads)


def ambiguous_keys(batch: DataFrame) -> bool:
    """True when a uid carries several ids or the reverse (one action)."""
    return len(routing.ambiguous_key_groups(batch).limit(1).collect()) > 0
