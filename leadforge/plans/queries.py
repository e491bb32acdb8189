"""Registered queries: one Spark plan per operator, each over the whole driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Doubles
are rounded to 6 places and timestamps rendered as text so that results can be
compared value by value with the SQL statements in ``plans.sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing, rules, text
from ..sources.tables import headers_map, messages, read_table
from ..operators import extract
from ..functions import lexicon as LX
from ..operators import evaluate as ev
from ..operators import nb
from ..sources.tables import labelled_messages
from ..operators import ensemble as ens
from ..operators import metrics as mx
from ..operators import upsert
from . import ingest
from ..operators import notify
from ..sources import mail, model_store
from ..operators import features as fx
from ..operators import logreg
from ..functions.ranking import ordered_running

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# Query parameters (shared with the SQL statements).
ALLOWED_DOMAINS = ["d1.example", "d2.example", "d3.example", "d5.example", "d8.example"]
# address headers that leave the plain forms; # stands for a number
ODD_HEADERS = [
    "Team: a#@d1.example, c@d2.example;", '"a b#"@d1.example', "Mia <m#@d1.example", "Rossi\\, Mia <m#@d1.example>",
    'Mia (a "b) Neri <m#@d1.example>', '"unclosed <m#@d1.example>', "<@d1.example>", "a b#@d1.example", "a#@b@d1.example",
    '"Neri, Q" <q#@D1.example>, x@d2.example', "Team:;", "q#@d1.example (Sig. (Q) Neri)",
]
# Date headers that leave the plain forms; # stands for a day
ODD_DATES = ["Mon Jan # 09:30:00 2024", "Mon, # Jan 2024 09.30.15 +0100", "# Jan 2024 09.30 GMT", "# January 2024 09:30:00 CEST",
             "# Sept 2024 09:30:00 +0000", "# Sep 2024 09:30:00 EDT", "Jan #, 2024", "# Jan 24 23:59"]
AS_OF_DATE = "2024-01-30"
SINCE_DAYS = 7
STORED_THRESHOLD = 0.7
NEGATIVE_PHRASES = ["richiesta informazioni", "newsletter"]
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def _ts(c):
    return F.date_format(c, TS_FMT)


# ---------------------------------------------------------------------------
# Slice 0: sender domains, allow-list, top domains
# ---------------------------------------------------------------------------

@register("sender_top_domains")
def sender_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: allowed senders' domains, top 10 by mail count (ties: first arrival)."""
    m = messages(spark, sf_dir).select("seq", "from_header")
    allowed, _ = routing.sender_check("from_header")
    return (
        m.filter(allowed)
        .select("seq", text.sender_domain("from_header").alias("domain"))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n_messages"), F.min("seq").alias("first_seq"))
        .orderBy(F.desc("n_messages"), F.asc("first_seq"))
        .limit(10)
    )


@register("sender_domain")
def q_sender_domain(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("seq", text.sender_domain("from_header").alias("sender_domain"))


def odd_headers(spark, sf_dir) -> DataFrame:
    """(seq, header): twelve forms of address headers in turn, over all messages."""
    m = messages(spark, sf_dir).select("seq")
    n, form = F.col("seq").cast("string"), F.lit(None).cast("string")
    for k, h in enumerate(ODD_HEADERS):
        form = F.when(F.floor(F.col("seq") / 2) % len(ODD_HEADERS) == k, F.replace(F.lit(h), F.lit("#"), n)).otherwise(form)
    return m.select("seq", form.alias("header"))


@register("odd_addresses")
def q_odd_addresses(spark, sf_dir):
    h = odd_headers(spark, sf_dir)
    allowed, _ = routing.sender_check("header", ["d1.example"])
    return h.select("seq", text.address_of("header").alias("address"), text.sender_domain("header").alias("domain"),
                    text.normalize_whitespace(text.display_name_of("header")).alias("name"), allowed.alias("allowed"))


@register("allowed_sender")
def q_allowed_sender(spark, sf_dir):
    m = messages(spark, sf_dir)
    allowed, reason = routing.sender_check("from_header", ALLOWED_DOMAINS)
    return m.select("seq", allowed.alias("allowed"), reason.alias("reason"))


@register("since_days")
def q_since_days(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.filter(text.since_days_filter("received_date", AS_OF_DATE, SINCE_DAYS)).select(
        "seq", F.date_format("received_date", "yyyy-MM-dd").alias("received_date")
    )


# ---------------------------------------------------------------------------
# Scalar projections
# ---------------------------------------------------------------------------

def _pages(spark, sf_dir) -> DataFrame:
    """Pages, every third with named and numeric entities and a bare ``<`` behind its markup."""
    planted = F.when(F.col("page_id") % 3 == 0, F.lit(" <p>Caff&egrave; &#233; &euro;5, 1 < 2 and 3 > 2</p>")).otherwise("")
    return read_table(spark, sf_dir, "pages").select("page_id", F.concat("html", planted).alias("html"))


@register("plain_text")
def q_plain_text(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", text.plain_text("html").alias("plain_text"))


@register("excerpt")
def q_excerpt(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", text.excerpt("html").alias("excerpt"))


@register("received_at")
def q_received_at(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("seq", _ts(text.received_at("date_header")).alias("received_at"))


@register("odd_dates")
def q_odd_dates(spark, sf_dir):
    m = messages(spark, sf_dir).select("seq", F.lpad((F.col("seq") % 28 + 1).cast("string"), 2, "0").alias("day"))
    d = F.lit(None).cast("string")
    for k, form in enumerate(ODD_DATES):
        d = F.when(F.floor(F.col("seq") / 2) % len(ODD_DATES) == k, F.replace(F.lit(form), F.lit("#"), F.col("day"))).otherwise(d)
    return m.select("seq", _ts(text.received_at(d)).alias("received_at"))


@register("combine_text")
def q_combine_text(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("seq", text.combine_text("subject", "body").alias("combined"))


@register("label_sanitize")
def q_label_sanitize(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select(
        "seq",
        text.sanitize_folder("folder").alias("folder_label"),
        text.sanitize_domain(text.sender_domain("from_header")).alias("domain_label"),
    )


# ---------------------------------------------------------------------------
# Rule scorer
# ---------------------------------------------------------------------------

@register("rule_tokens")
def q_rule_tokens(spark, sf_dir):
    m = messages(spark, sf_dir)
    toks = rules.rule_tokens("body")
    return m.select("seq", F.array_join(toks, " ").alias("tokens"), F.size(toks).alias("n_tokens"))


@register("segment_score")
def q_segment_score(spark, sf_dir):
    m = messages(spark, sf_dir).select(
        "seq", rules.rule_tokens("subject").alias("ts"), rules.rule_tokens("body").alias("tb")
    )
    return m.select(
        "seq",
        rules.segment_score_of_tokens(F.col("ts")).alias("subject_score"),
        rules.segment_score_of_tokens(F.col("tb")).alias("body_score"),
    )


@register("rule_score")
def q_rule_score(spark, sf_dir):
    m = messages(spark, sf_dir)
    return rules.with_rule_score(m.select("seq", headers_map(m).alias("h"), "body"), "h", "body").select(
        "seq", "rule_score")


@register("rule_leads")
def q_rule_leads(spark, sf_dir):
    m = messages(spark, sf_dir)
    s = rules.with_rule_score(m.select("seq", headers_map(m).alias("h"), "body"), "h", "body")
    return s.select("seq", "rule_score").filter(rules.rule_is_lead("rule_score"))


@register("negative_veto")
def q_negative_veto(spark, sf_dir):
    lex = rules.compile_lexicon(negative_keywords=NEGATIVE_PHRASES)
    m = messages(spark, sf_dir)
    s = rules.with_rule_score(m.select("seq", headers_map(m).alias("h"), "body"), "h", "body", lex,
                              veto_col="vetoed")
    return s.select("seq", "vetoed", "rule_score")


# ---------------------------------------------------------------------------
# Contact extraction
# ---------------------------------------------------------------------------


@register("extract_email")
def q_extract_email(spark, sf_dir):
    m = messages(spark, sf_dir)
    hdr = extract.header_contact(headers_map(m))
    return m.select("seq", F.coalesce(hdr["email"], extract.body_email("body")).alias("email"))


@register("split_name")
def q_split_name(spark, sf_dir):
    m = messages(spark, sf_dir)
    parts = extract.split_name(text.display_name_of("from_header"))
    return m.select("seq", parts["first_name"].alias("first_name"), parts["last_name"].alias("last_name"))


@register("phone_candidates")
def q_phone_candidates(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = m.select("seq", F.explode(extract.phone_candidates("body")).alias("c"))
    return c.select("seq", F.col("c.line").alias("line"), F.col("c.pos").alias("pos"),
                    F.col("c.score").alias("score"), F.col("c.raw").alias("raw"), F.col("c.number").alias("number"))


@register("normalize_phone")
def q_normalize_phone(spark, sf_dir):
    m = messages(spark, sf_dir)
    from ..functions.patterns import PHONE
    raw = m.select("seq", F.posexplode(F.regexp_extract_all("body", F.lit(PHONE), 0)).alias("pos", "raw"))
    return raw.select("seq", "pos", "raw", extract.normalize_phone("raw").alias("number"))


@register("phone_label_score")
def q_phone_label_score(spark, sf_dir):
    m = messages(spark, sf_dir)
    lines = m.select("seq", F.posexplode(text.split_lines("body")).alias("line_no", "line"))
    return lines.select("seq", "line_no", extract.phone_label_score("line").alias("score"),
                        extract.fax_only("line").alias("fax_only"))


@register("best_phone")
def q_best_phone(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("seq", extract.best_phone("body").alias("phone"))


@register("company_phrase")
def q_company_phrase(spark, sf_dir):
    m = messages(spark, sf_dir)
    cp = extract.company_phrase("body")
    return m.select("seq", cp["company"].alias("company"), cp["name"].alias("name"))


@register("clean_company")
def q_clean_company(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select(
        "seq",
        extract.clean_company(extract.org_from_lines("body")).alias("clean_org"),
        extract.clean_company("subject").alias("clean_subject"),
    )


@register("org_from_line")
def q_org_from_line(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("seq", extract.org_from_lines("body").alias("org"))


@register("parse_contact")
def q_parse_contact(spark, sf_dir):
    m = messages(spark, sf_dir)
    pc = m.select("seq", extract.parse_contact("body", headers_map(m)).alias("c"))
    return pc.select("seq", *[F.col(f"c.{f}").alias(f) for f in ("first_name", "last_name", "email", "phone", "org")])


# ---------------------------------------------------------------------------
# Classifier: features, training, scoring, evaluation
# ---------------------------------------------------------------------------


TEST_SIZE = 0.2
LOGREG_TOLERANCE = 1e-6
SPLIT_SEED = 42


def _r6(c):
    return F.round(c, 6)


def scored_messages_text(m: DataFrame) -> DataFrame:
    return m.select("seq", text.combine_text("subject", "body").alias("text"))


@register("ml_tokens")
def q_ml_tokens(spark, sf_dir):
    t = scored_messages_text(messages(spark, sf_dir)).select("seq", nb.ml_tokens("text").alias("t"))
    return t.select("seq", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


@register("bigrams")
def q_bigrams(spark, sf_dir):
    t = scored_messages_text(messages(spark, sf_dir)).select("seq", nb.ml_tokens("text").alias("t"))
    b = t.select("seq", nb.bigrams("t").alias("b"))
    return b.select("seq", F.array_join("b", "|").alias("bigrams"), F.size("b").alias("n_bigrams"))


@register("text_features")
def q_text_features(spark, sf_dir):
    t = scored_messages_text(messages(spark, sf_dir)).select("seq", nb.text_features("text").alias("f"))
    return t.select("seq", *[_r6(F.col(f"f.{n}")).alias(n) for n in LX.FEATURE_NAMES])


@register("feature_tokens")
def q_feature_tokens(spark, sf_dir):
    t = scored_messages_text(messages(spark, sf_dir)).select("seq", nb.text_features("text").alias("f"))
    return t.select("seq", F.array_join(nb.feature_tokens("f"), " ").alias("feature_tokens"))


@register("class_term_counts")
def q_class_term_counts(spark, sf_dir):
    return nb.class_term_counts(labelled_messages(spark, sf_dir))


@register("nb_stats")
def q_nb_stats(spark, sf_dir):
    train = labelled_messages(spark, sf_dir)
    s = nb.nb_stats(train, nb.class_term_counts(train))
    return s.select("stat", _r6(F.col("value")).alias("value"))


@register("feature_weights")
def q_feature_weights(spark, sf_dir):
    w = nb.feature_weights(labelled_messages(spark, sf_dir))
    return w.select("feature", _r6(F.col("weight")).alias("weight"))


_MODELS: dict = {}


def _model_on_all(spark, sf_dir) -> nb.NBModel:
    """The model trained on every labelled message (trained once per application)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = nb.train_nb(labelled_messages(spark, sf_dir))
    return _MODELS[key]


@register("nb_score")
def q_nb_score(spark, sf_dir):
    model = _model_on_all(spark, sf_dir)
    s = nb.nb_score(scored_messages_text(messages(spark, sf_dir)), model, "seq", "text")
    return s.select("seq", _r6(F.col("nb_score")).alias("nb_score"))


@register("nb_decision")
def q_nb_decision(spark, sf_dir):
    model = _model_on_all(spark, sf_dir)
    s = nb.nb_score(scored_messages_text(messages(spark, sf_dir)), model, "seq", "text")
    return s.select("seq", nb.nb_decision("nb_score", model).alias("is_lead"))


@register("confidence_band")
def q_confidence_band(spark, sf_dir):
    model = _model_on_all(spark, sf_dir)
    s = nb.nb_score(scored_messages_text(messages(spark, sf_dir)), model, "seq", "text")
    return s.select("seq", text.confidence_band("nb_score").alias("confidence"))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    lab = labelled_messages(spark, sf_dir).select("id", "label")
    return ev.stratified_split(lab, test_size=TEST_SIZE, seed=SPLIT_SEED)


_SCORED: dict = {}


def split_scored(spark, sf_dir) -> DataFrame:
    """Train on the split's train rows, score its test rows: (id, label, score).

    The scored test rows are checkpointed (curves and metrics read them several
    times) and reused within one application.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORED:
        _SCORED[key] = _split_scored(spark, sf_dir).checkpoint(eager=True)
    return _SCORED[key]


def _split_scored(spark, sf_dir) -> DataFrame:
    lab = labelled_messages(spark, sf_dir)
    split = ev.stratified_split(lab.select("id", "label"), test_size=TEST_SIZE, seed=SPLIT_SEED)
    flags = split.select("id", "is_train", "is_test")
    data = lab.join(flags, "id")
    return _score_held_out(nb.train_nb(data.filter("is_train")), data.filter("is_test"))


def _score_held_out(model, test) -> DataFrame:
    return test.select("id", "label").join(nb.nb_score(test, model, "id", "text", out="score"), "id")


@register("confusion")
def q_confusion(spark, sf_dir):
    return ev.confusion(split_scored(spark, sf_dir))


@register("classif_metrics")
def q_classif_metrics(spark, sf_dir):
    m = ev.metrics_from_confusion(ev.confusion(split_scored(spark, sf_dir)))
    return m.select("tp", "fp", "tn", "fn", *[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    "overfit")


@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    r = ev.roc_curve(split_scored(spark, sf_dir))
    return r.select("point", *[_r6(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")])


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    a = ev.roc_auc(ev.roc_curve(split_scored(spark, sf_dir)))
    return a.select(_r6(F.col("roc_auc")).alias("roc_auc"))


@register("pr_curve")
def q_pr_curve(spark, sf_dir):
    r = ev.pr_curve(split_scored(spark, sf_dir))
    return r.select("point", *[_r6(F.col(c)).alias(c) for c in ("threshold", "precision", "recall")])


_EVALUATED: dict = {}


def evaluated_model(spark, sf_dir) -> str:
    """Train, save, load again, score the held-out rows, evaluate at the model's own threshold and
    write metrics and curves (S10, V7, S11); the folder is reused within one application."""
    from ..session import scratch_path
    from ..sources.sinks import write_evaluation
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EVALUATED:
        base = scratch_path(spark, "evaluated")
        lab = labelled_messages(spark, sf_dir)
        split = ev.stratified_split(lab.select("id", "label"), test_size=TEST_SIZE, seed=SPLIT_SEED)
        data = lab.join(split.select("id", "is_train", "is_test"), "id")
        model_store.save_model(spark, nb.train_nb(data.filter("is_train")), f"{base}/model", threshold=STORED_THRESHOLD)
        model = model_store.load_model(spark, f"{base}/model")
        scored = _checkpoint(_score_held_out(model, data.filter("is_test")))
        write_evaluation(f"{base}/out", ev.evaluate(scored, threshold=model.threshold), ev.roc_curve(scored), ev.pr_curve(scored))
        _EVALUATED[key] = f"{base}/out"
    return _EVALUATED[key]


@register("evaluate_model")
def q_evaluate_model(spark, sf_dir):
    e = spark.read.schema("metric string, value double").json(f"{evaluated_model(spark, sf_dir)}/metrics")
    return e.select("metric", _r6(F.col("value")).alias("value"))


@register("evaluation_curves")
def q_evaluation_curves(spark, sf_dir):
    out = evaluated_model(spark, sf_dir)
    roc = spark.read.schema("point long, threshold double, fpr double, tpr double").json(f"{out}/roc_curve")
    pr = spark.read.schema("point long, threshold double, precision double, recall double").json(f"{out}/pr_curve")
    return (roc.select(F.lit("roc").alias("curve"), "point", "threshold", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
            .unionByName(pr.select(F.lit("pr").alias("curve"), "point", "threshold", F.col("recall").alias("x"),
                                   F.col("precision").alias("y")))
            .select("curve", "point", *[_r6(F.col(c)).alias(c) for c in ("threshold", "x", "y")]))


# ---------------------------------------------------------------------------
# Ensemble and runner strategies
# ---------------------------------------------------------------------------


def ml_and_rule_scores(spark, sf_dir) -> DataFrame:
    """(seq, rule_score, ml_score) for every message; the rule score rides through the NB aggregate."""
    model = _model_on_all(spark, sf_dir)
    m = messages(spark, sf_dir)
    base = rules.with_rule_score(m.select("seq", headers_map(m).alias("h"), "subject", "body"), "h", "body")
    base = base.select("seq", "rule_score", text.combine_text("subject", "body").alias("text"))
    return nb.nb_score(base, model, "seq", "text", out="ml_score", carry=["rule_score"])


@register("ensemble_score")
def q_ensemble_score(spark, sf_dir):
    s = ml_and_rule_scores(spark, sf_dir).select("seq", ens.ensemble_score("ml_score", "rule_score").alias("e"))
    return s.select("seq", _r6(F.col("e.score")).alias("score"), F.col("e.confidence").alias("confidence"),
                    F.col("e.method").alias("method"))


@register("ensemble_rule_only")
def q_ensemble_rule_only(spark, sf_dir):
    m = messages(spark, sf_dir)
    base = rules.with_rule_score(m.select("seq", headers_map(m).alias("h"), "body"), "h", "body")
    e = base.select("seq", ens.ensemble_score(F.lit(None).cast("double"), "rule_score", ml_available=False).alias("e"))
    return e.select("seq", _r6(F.col("e.score")).alias("score"), F.col("e.confidence").alias("confidence"),
                    F.col("e.method").alias("method"))


@register("ensemble_ml_only")
def q_ensemble_ml_only(spark, sf_dir):
    model = _model_on_all(spark, sf_dir)
    m = nb.nb_score(scored_messages_text(messages(spark, sf_dir)), model, "seq", "text", out="ml_score")
    e = m.select("seq", ens.ensemble_score("ml_score", F.lit(None).cast("double"), "ml").alias("e"))
    return e.select("seq", _r6(F.col("e.score")).alias("score"), F.col("e.confidence").alias("confidence"),
                    F.col("e.method").alias("method"))


@register("ensemble_decision")
def q_ensemble_decision(spark, sf_dir):
    s = ml_and_rule_scores(spark, sf_dir).select("seq", ens.ensemble_score("ml_score", "rule_score").alias("e"))
    return s.select("seq", ens.ensemble_decision("e").alias("is_lead"),
                    _r6(ens.ensemble_threshold(F.col("e.confidence"))).alias("applied_threshold"))


@register("ensemble_explain")
def q_ensemble_explain(spark, sf_dir):
    s = ml_and_rule_scores(spark, sf_dir).select(
        "seq", ens.ensemble_explain(ens.ensemble_score("ml_score", "rule_score")).alias("x"))
    return s.select(
        "seq", F.col("x.is_lead").alias("is_lead"), _r6(F.col("x.score")).alias("score"),
        F.col("x.confidence").alias("confidence"), F.col("x.explanation.method").alias("method"),
        _r6(F.col("x.explanation.ml_score")).alias("ml_score"),
        F.col("x.explanation.ml_confidence").alias("ml_confidence"),
        _r6(F.col("x.explanation.rule_score")).alias("rule_score"),
        _r6(F.col("x.explanation.rule_normalized")).alias("rule_normalized"),
        _r6(F.col("x.explanation.agreement")).alias("agreement"),
        F.col("x.threshold").alias("threshold"), _r6(F.col("x.applied_threshold")).alias("applied_threshold"),
    )


@register("runner_strategy")
def q_runner_strategy(spark, sf_dir):
    s = ml_and_rule_scores(spark, sf_dir)
    cols = []
    for strat in ("rule_based", "ml", "hybrid"):
        r = ens.runner_strategy("ml_score", "rule_score", strat)
        cols += [r["is_lead"].alias(f"{strat}_lead"), _r6(r["score"]).alias(f"{strat}_score"),
                 r["confidence"].alias(f"{strat}_confidence")]
    return s.select("seq", *cols)


# ---------------------------------------------------------------------------
# Ingestion runs: dedup, routing, upsert, sinks and run summaries
# ---------------------------------------------------------------------------


RUN1_BEFORE = "2024-01-16"          # run 1 saw the mail received before this date
RUN1_TS = "2024-01-16 00:00:00"
RUN2_TS = "2024-02-01 00:00:00"
PIPELINE_DOMAINS = ["d0.example", "d1.example", "d2.example", "d3.example", "d5.example", "d6.example",
                    "d8.example", "d9.example"]
LEAD_HEADERS = ["Email", " company ", "", "Phone", "NOTES", "fax"]
PAGE_OFFSET, PAGE_LIMIT = 100, 50
DEDUP_HORIZON = "60 days"
METRICS_FOLDER = "INBOX"
SHEET_FILE = "leads.xlsx"
MAIL_FOLDER = "maildrop"
LEGACY_SPAN = 400  # two ids a document


_RUNS: dict = {}


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss)."""
    return df.checkpoint(eager=True)


def two_runs(spark, sf_dir):
    """Run 1 over the early mail (empty ledger and contacts), run 2 over the whole batch.

    Each run's outcomes are checkpointed and run 1's contacts and ledger are
    checkpointed before run 2 reads them, as separate scheduled runs would
    persist them. Results are reused within one application.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _RUNS:
        return _RUNS[key]
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    allm = messages(spark, sf_dir)
    first = allm.filter(F.col("received_date") < F.lit(RUN1_BEFORE).cast("date"))
    r1 = ingest.run(first, ingest.empty_ledger(spark), upsert.empty_contacts(spark),
                    ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN1_TS), cut=_checkpoint)
    r1 = ingest.RunResult(r1.outcomes, _checkpoint(r1.contacts), _checkpoint(r1.ledger), r1.events,
                          _checkpoint(r1.new_leads))
    r2 = ingest.run(allm, r1.ledger.select("message_id", "imap_uid"), r1.contacts,
                    ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN2_TS), cut=_checkpoint)
    _RUNS[key] = (allm, r1, r2)
    return _RUNS[key]


@register("unseen_messages")
def q_unseen_messages(spark, sf_dir):
    allm, r1, _ = two_runs(spark, sf_dir)
    f = routing.seen_flags(allm, r1.ledger.select("message_id", "imap_uid"))
    return f.filter(~F.col("seen_by_id") & ~F.col("seen_by_uid")).select("seq")


@register("batch_dedup")
def q_batch_dedup(spark, sf_dir):
    allm = messages(spark, sf_dir)
    return routing.duplicate_flags(allm).select("seq", "duplicate")


@register("route_outcome")
def q_route_outcome(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return r2.outcomes.select("seq", "outcome", "status", "reason", _r6(F.col("lead_score")).alias("lead_score"),
                              "confidence")


def _contact_cols(df):
    return df.select(
        "id", "email", "first_name", "last_name", "phone", "org", "source", "consent",
        _ts(F.col("created_at")).alias("created_at"), "last_message_subject",
        _ts(F.col("last_message_received_at")).alias("last_message_received_at"), "last_message_excerpt")


@register("contact_upsert")
def q_contact_upsert(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return _contact_cols(r2.contacts)


@register("created_flag")
def q_created_flag(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return r2.outcomes.filter(F.col("outcome") == "processed").select("seq", "email", "created")


@register("ledger_rows")
def q_ledger_rows(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return r2.ledger.select("seq", "message_id", "imap_uid")


@register("contact_events")
def q_contact_events(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    e = r2.events
    return e.select(
        "seq", "contact_id", "event_type", _ts(F.col("occurred_at")).alias("occurred_at"),
        F.col("payload.headers")["Message-ID"].alias("header_message_id"),
        F.col("payload.headers")["From"].alias("header_from"),
        F.col("payload.extracted.email").alias("extracted_email"),
        F.col("payload.extracted.phone").alias("extracted_phone"),
        F.col("payload.extracted.org").alias("extracted_org"),
        F.col("payload.received_at").alias("received_at"),
        F.col("payload.body_excerpt").alias("body_excerpt"),
    )


def _lead_rows(df):
    return df.select("seq", _ts(F.col("inserted_at")).alias("inserted_at"), "email", "first_name", "last_name",
                     "company", "phone", "subject", _ts(F.col("received_at")).alias("received_at"), "notes")


@register("new_leads")
def q_new_leads(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return _lead_rows(r2.new_leads)


@register("lead_projection")
def q_lead_projection(spark, sf_dir):
    from ..sources.sinks import project_columns
    _, _, r2 = two_runs(spark, sf_dir)
    return project_columns(_lead_rows(r2.new_leads), LEAD_HEADERS, keep=["seq"])


@register("contacts_export")
def q_contacts_export(spark, sf_dir):
    from ..sources.sinks import contacts_export
    _, _, r2 = two_runs(spark, sf_dir)
    return contacts_export(r2.contacts)


@register("contacts_page")
def q_contacts_page(spark, sf_dir):
    from ..sources.sinks import contacts_page
    _, _, r2 = two_runs(spark, sf_dir)
    return _contact_cols(contacts_page(r2.contacts, limit=PAGE_LIMIT, offset=PAGE_OFFSET))


@register("contacts_next_page")
def q_contacts_next_page(spark, sf_dir):
    """The page behind that of ``contacts_page``, sought by the key of its last row."""
    from ..sources.sinks import contacts_page_after
    _, _, r2 = two_runs(spark, sf_dir)
    return _contact_cols(contacts_page_after(r2.contacts, limit=PAGE_LIMIT, offset=PAGE_OFFSET))


@register("run_stats")
def q_run_stats(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return mx.run_stats(r2.outcomes)


@register("metrics_snapshot")
def q_metrics_snapshot(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return mx.metrics_snapshot(r2.outcomes)


@register("metrics_by_folder")
def q_metrics_by_folder(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return mx.metrics_snapshot(r2.outcomes, folder=METRICS_FOLDER)


def _sheet(spark, sf_dir):
    """The lead sheet after both runs: run 1's rows, then run 2's."""
    _, r1, r2 = two_runs(spark, sf_dir)
    return (r1.new_leads.withColumn("sheet_order", F.struct(F.lit(1).alias("run"), F.col("seq").alias("seq")))
            .unionByName(r2.new_leads.withColumn("sheet_order", F.struct(F.lit(2).alias("run"), F.col("seq").alias("seq")))))


@register("lead_summary")
def q_lead_summary(spark, sf_dir):
    return mx.lead_summary(_sheet(spark, sf_dir))


@register("top_domains")
def q_top_domains(spark, sf_dir):
    top = mx.top_lead_domains(_sheet(spark, sf_dir), order_col="sheet_order")
    return top.select("domain", "leads", F.col("first_seen.run").alias("first_run"), F.col("first_seen.seq").alias("first_seen"))


@register("discovered_gauge")
def q_discovered_gauge(spark, sf_dir):
    allm, r1, r2 = two_runs(spark, sf_dir)
    first = allm.filter(F.col("received_date") < F.lit(RUN1_BEFORE).cast("date"))
    runs = mx.discovered_counts(first, RUN1_TS).unionByName(mx.discovered_counts(allm, RUN2_TS))
    return mx.discovered_gauge(runs)


@register("run_progress")
def q_run_progress(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    p = mx.run_progress(r2.outcomes)
    return p.select("seq", "processed", "skipped", "leads", "legacy_emit")


@register("outcome_counts")
def q_outcome_counts(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    return mx.outcome_counts(r2.outcomes)


# ---------------------------------------------------------------------------
# Sources: raw mail, labelled lines, saved models; timestamp coercion; notices
# ---------------------------------------------------------------------------


@register("eml_load")
def q_eml_load(spark, sf_dir):
    raw = mail.render_raw(messages(spark, sf_dir))
    p = mail.parse_raw(raw, "path", "content")
    return p.select("path", "message_id", "from_header", "subject",
                    _ts(text.received_at("date_header")).alias("received_at"), "body")


def raw_mail(spark, sf_dir) -> DataFrame:
    """The batch as raw mail with ``To`` and some ``Reply-To`` headers; every 83rd mail is broken: nothing, blanks or no headers."""
    m = messages(spark, sf_dir)
    u = (F.floor(F.col("seq") / 2) % 31).cast("string")
    m = m.withColumn("to_header", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("Vendite <vendite"), u, F.lit("@ours.example>"))))
    m = m.withColumn("reply_to", F.when(F.col("seq") % 29 == 0, F.concat(F.lit("Sara Blu <sara"), u, F.lit("@risposte.example>"))))
    seq = F.col("path").cast("long")
    broken = F.when(seq % 3 == 0, F.lit(None).cast("string")).when(seq % 3 == 1, F.lit(" \n ")).otherwise(F.lit("\nno header"))
    return mail.render_raw(m).withColumn("content", F.when(seq % 83 == 0, broken).otherwise(F.col("content")))


_MAIL_RUNS: dict = {}


def mail_run(spark, sf_dir) -> ingest.RunResult:
    """Raw mail to contacts in one plan: parse, number, route, extract, upsert (reused within one application)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MAIL_RUNS:
        parsed = mail.parse_raw(raw_mail(spark, sf_dir), "path", "content", faults=True)
        batch = _checkpoint(mail.to_batch(parsed, F.col("path"), MAIL_FOLDER))
        _MAIL_RUNS[key] = ingest.run(batch, ingest.empty_ledger(spark), upsert.empty_contacts(spark),
                                     ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN2_TS), cut=_checkpoint)
    return _MAIL_RUNS[key]


@register("mail_contacts")
def q_mail_contacts(spark, sf_dir):
    return _contact_cols(mail_run(spark, sf_dir).contacts)


@register("mail_events")
def q_mail_events(spark, sf_dir):
    h = F.col("payload.headers")
    return mail_run(spark, sf_dir).events.select(
        "seq", "contact_id", h["Message-ID"].alias("header_message_id"), h["From"].alias("header_from"), h["To"].alias("header_to"),
        h["Reply-To"].alias("header_reply_to"), h["Subject"].alias("header_subject"), _ts(text.received_at(h["Date"])).alias("received_at"),
        F.col("payload.extracted.email").alias("extracted_email"), F.col("payload.extracted.first_name").alias("extracted_first_name"))


@register("mail_outcomes")
def q_mail_outcomes(spark, sf_dir):
    return mail_run(spark, sf_dir).outcomes.select("seq", "folder", "outcome", "status", "reason")


@register("mail_metrics")
def q_mail_metrics(spark, sf_dir):
    """Counters of the mail run by (folder, domain), the error counter among them."""
    return mx.counter_rows(mail_run(spark, sf_dir).outcomes)


def labelled_lines(spark, sf_dir) -> DataFrame:
    """JSON lines of the labelled messages with planted blank, truncated and label-less lines."""
    lab = messages(spark, sf_dir, with_copies=False).filter(F.col("label").isNotNull())
    full = F.to_json(F.struct("label", "subject", "body"))
    line = (F.when(F.col("seq") % 83 == 0, F.lit(""))
            .when(F.col("seq") % 97 == 0, F.expr("substring(to_json(struct(label, subject, body)), 1, "
                                                 "cast(length(to_json(struct(label, subject, body))) / 2 as int))"))
            .when(F.col("seq") % 89 == 0, F.to_json(F.struct("subject", "body")))
            .otherwise(full))
    return lab.select("seq", line.alias("value"))


@register("label_check")
def q_label_check(spark, sf_dir):
    return mail.label_check(labelled_lines(spark, sf_dir))


@register("nb_model_terms")
def q_nb_model_terms(spark, sf_dir):
    from ..session import scratch_path
    model = nb.train_nb(labelled_messages(spark, sf_dir))
    path = scratch_path(spark, "model")
    model_store.save_model(spark, model, path, threshold=LX.ML_THRESHOLD)
    return model_store.load_model(spark, path).terms.select("kind", "term", "n_pos", "n_neg")


def legacy_documents(spark, sf_dir) -> DataFrame:
    """(model, value): a version-2 JSON document for every 200 documents' labelled messages."""
    lab = labelled_messages(spark, sf_dir).select(F.floor(F.col("id") / LEGACY_SPAN).alias("model"), "label", "text")
    kinds = F.array(F.struct(F.lit(nb.UNIGRAM).alias("kind"), F.col("_tok").alias("terms")),
                    F.struct(F.lit(nb.BIGRAM).alias("kind"), F.col("_big").alias("terms")))
    counts = (nb.with_terms(lab, "text").select("model", "label", F.explode(kinds).alias("k"))
              .select("model", "label", "k.kind", F.explode("k.terms").alias("term"))
              .groupBy("model", "label", "kind", "term").agg(F.count(F.lit(1)).alias("n")))

    def table(kind, label):
        mine = (F.col("kind") == kind) & (F.col("label") == label)
        return F.map_from_entries(F.collect_list(F.when(mine, F.struct("term", "n"))))
    maps = counts.groupBy("model").agg(*[table(k, y).alias(f"{k}{y}") for k in (nb.UNIGRAM, nb.BIGRAM) for y in (1, 0)])
    both = [F.create_map(F.lit("1"), F.col(f"{k}1"), F.lit("0"), F.col(f"{k}0")) for k in (nb.UNIGRAM, nb.BIGRAM)]
    return maps.select("model", F.to_json(F.struct(
        F.lit(2).alias("version"), both[0].alias("token_counts"), both[1].alias("bigram_counts"))).alias("value"))


@register("legacy_model_terms")
def q_legacy_model_terms(spark, sf_dir):
    """Model documents written out, read back and taken apart in one job."""
    from ..session import scratch_path
    path = scratch_path(spark, "legacy")
    legacy_documents(spark, sf_dir).write.parquet(path)
    return model_store.legacy_terms(spark.read.parquet(path))


@register("coerce_ts")
def q_coerce_ts(spark, sf_dir):
    ev_ = read_table(spark, sf_dir, "events")
    raw = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("garbage-"), F.col("event_id").cast("string")))
           .when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
           .otherwise(F.col("ts").cast("string")))
    x = ev_.select("event_id", raw.alias("raw"))
    c = text.coerce_timestamp("raw")
    return x.select("event_id", F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("raw")).alias("value"),
                    c.isNotNull().alias("parsed"))


@register("lead_outbox")
def q_lead_outbox(spark, sf_dir):
    _, _, r2 = two_runs(spark, sf_dir)
    leads = r2.new_leads.join(r2.events.select("seq", F.col("payload.headers")["Date"].alias("date_header")), "seq")
    n = notify.new_lead_notice("subject", "first_name", "last_name", "email", "company", "phone",
                               text.received_at_iso_local("date_header"), "notes")
    return leads.select("seq", n["subject"].alias("subject"), n["body"].alias("body"))


@register("sheet_notice")
def q_sheet_notice(spark, sf_dir):
    """One notice per row that run 2 appends to the sheet; the header is row 1 and run 1's rows come before."""
    _, r1, r2 = two_runs(spark, sf_dir)
    rows = ordered_running(r2.new_leads, ["seq"], rank_col="row")
    n = notify.sheet_update_notice("first_name", "last_name", "email", "company", "phone", "notes", SHEET_FILE,
                                   F.col("row") + (r1.new_leads.count() + 1),
                                   F.date_format("inserted_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("seq", n["subject"].alias("subject"), n["body"].alias("body"))


@register("events_json")
def q_events_json(spark, sf_dir):
    """The JSON payload of every event, read back field by field."""
    from ..sources.sinks import events_json
    _, _, r2 = two_runs(spark, sf_dir)
    paths = {"header_message_id": "$.headers.Message-ID", "header_date": "$.headers.Date", "header_subject": "$.headers.Subject",
             "extracted_email": "$.extracted.email", "extracted_first_name": "$.extracted.first_name",
             "received_at": "$.received_at", "body_excerpt": "$.body_excerpt"}
    e = events_json(r2.events)
    return e.select("seq", "contact_id", *[F.get_json_object("payload", p).alias(c) for c, p in paths.items()],
                    F.col("payload").contains('"To":null').alias("keeps_null_headers"))


# ---------------------------------------------------------------------------
# Augmentation, TF-IDF, logistic regression
# ---------------------------------------------------------------------------


@register("augment")
def q_augment(spark, sf_dir):
    return fx.augment(labelled_messages(spark, sf_dir))


@register("tfidf_weights")
def q_tfidf_weights(spark, sf_dir):
    w = fx.tfidf_weights(labelled_messages(spark, sf_dir))
    return w.select("id", "term", _r6(F.col("weight")).alias("weight"))


@register("logreg_scores")
def q_logreg_scores(spark, sf_dir):
    from ..session import written
    lab = labelled_messages(spark, sf_dir)
    split = ev.stratified_split(lab.select("id", "label"), test_size=TEST_SIZE, seed=SPLIT_SEED)
    data = written(lab.select("id", "label", "text").join(split.select("id", "is_train", "is_test"), "id"), "labelled")
    test = data.filter("is_test")
    model = logreg.fit(data.filter("is_train"), tolerance=LOGREG_TOLERANCE)
    return test.select("id", "label").join(logreg.score(test, model, out="score"), "id").withColumn("score", F.round("score", 3))


# ---------------------------------------------------------------------------
# Streaming: ingest stream, keyed contact state, replay, live totals
# ---------------------------------------------------------------------------

_STREAMS: dict = {}


def stream_fixture(spark, sf_dir):
    """Drop the batch as daily files, drain it with the ingest stream (T1), feed its outcomes to
    the contact-state (T2) and totals (T4) streams, then replay the same files (T3)."""
    from ..session import scratch_path
    from ..streaming import ingest_stream as S

    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STREAMS:
        return _STREAMS[key]
    base = scratch_path(spark, "stream")
    drop, state = f"{base}/drop", f"{base}/state"
    S.write_mail_drop(messages(spark, sf_dir), drop)
    schema = spark.read.parquet(drop).schema
    cfg = ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN2_TS)
    S.start_ingest(spark, drop, state, f"{base}/ckpt_ingest", schema, cfg, files_per_trigger=80,
                   epoch=1).awaitTermination()

    S.start_contact_state(spark, state, f"{base}/contact_parts", f"{base}/ckpt_state").awaitTermination()
    S.start_live_totals(spark, state, f"{base}/totals", f"{base}/ckpt_totals").awaitTermination()

    ledger_before = spark.read.parquet(f"{state}/ledger").count()
    S.start_ingest(spark, drop, state, f"{base}/ckpt_replay", schema, cfg, files_per_trigger=80,
                   epoch=2).awaitTermination()
    _STREAMS[key] = {"base": base, "state": state, "ledger_before": ledger_before}
    return _STREAMS[key]


@register("stream_contacts")
def q_stream_contacts(spark, sf_dir):
    from ..streaming import ingest_stream as S
    c = S.read_contact_state(spark, f"{stream_fixture(spark, sf_dir)['base']}/contact_parts")
    return c.select("email", "first_name", "last_name", "phone", "org", "last_message_subject",
                    _ts(F.col("last_message_received_at")).alias("last_message_received_at"), "last_message_excerpt")


@register("stream_totals")
def q_stream_totals(spark, sf_dir):
    from ..streaming import ingest_stream as S
    return S.read_live_totals(spark, f"{stream_fixture(spark, sf_dir)['base']}/totals")


@register("stream_watermark_dedup")
def q_stream_watermark_dedup(spark, sf_dir):
    """T3 with a bounded horizon that spans the fixture's days: every message key stays once."""
    from ..session import scratch_path
    from ..streaming import ingest_stream as S
    base = scratch_path(spark, "watermark")
    S.write_mail_drop(messages(spark, sf_dir), f"{base}/drop")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/drop").schema).parquet(f"{base}/drop")
    kept = S.dedup_within_watermark(src.withColumn("received_ts", F.col("received_date").cast("timestamp")),
                                    "received_ts", DEDUP_HORIZON)
    (kept.select("message_id", "imap_uid").writeStream.option("checkpointLocation", f"{base}/ckpt")
     .option("path", f"{base}/kept").format("parquet").trigger(availableNow=True).start().awaitTermination())
    return (spark.read.parquet(f"{base}/kept").groupBy(routing.ledger_key("message_id", "imap_uid").alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("stream_replay")
def q_stream_replay(spark, sf_dir):
    fx_ = stream_fixture(spark, sf_dir)
    state = fx_["state"]
    replay = F.col("batch_id") >= 2 * 1_000_000_000
    ledger = spark.read.parquet(f"{state}/ledger").agg(
        F.count(F.lit(1)).alias("ledger_rows"), F.count_if(replay).alias("replay_ledger_rows"))
    outcomes = spark.read.parquet(f"{state}/outcomes").agg(
        F.count_if(replay).alias("replay_rows"),
        F.count_if(replay & (F.col("outcome") != "duplicate")).alias("replay_not_duplicate")).first()
    return ledger.select(
        "ledger_rows", "replay_ledger_rows", F.lit(fx_["ledger_before"]).cast("long").alias("ledger_rows_before"),
        F.lit(outcomes["replay_rows"]).alias("replay_rows"), F.lit(outcomes["replay_not_duplicate"]).alias("replay_not_duplicate"))
