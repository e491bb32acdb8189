"""Registered queries against their SQL statements (DuckDB) on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from leadforge.plans.queries import QUERIES
from leadforge.sources.tables import TABLES

FAST = [
    "sender_top_domains", "allowed_sender", "since_days", "plain_text", "excerpt", "received_at", "rule_score",
    "negative_veto", "extract_email", "best_phone", "company_phrase", "org_from_line", "parse_contact",
    "text_features", "class_term_counts", "nb_score", "stratified_split", "roc_curve", "evaluate_model",
    "ensemble_explain", "runner_strategy", "route_outcome", "contact_upsert", "ledger_rows", "new_leads",
    "run_progress", "metrics_snapshot", "top_domains", "augment", "tfidf_weights", "label_check", "eml_load",
    "coerce_ts", "lead_outbox", "evaluation_curves", "ensemble_ml_only", "metrics_by_folder", "sheet_notice", "events_json",
    "contacts_next_page", "legacy_model_terms", "mail_contacts", "mail_events", "mail_outcomes", "mail_metrics",
]


def _rows(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "item"):
            return norm(v.item())
        return str(v) if not isinstance(v, (int, str, bool)) else v
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(QUERIES) <= set(sqls)  # every application query has a statement


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert 0 < len(rows) <= 10


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)
