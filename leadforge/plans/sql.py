"""Oracle SQL (DuckDB dialect) for every registered query in ``plans.queries``."""

from __future__ import annotations

from ..operators.rules import compile_lexicon
from . import oracle as O
from .queries import (
    ALLOWED_DOMAINS, AS_OF_DATE, LEAD_HEADERS, LEGACY_SPAN, METRICS_FOLDER, NEGATIVE_PHRASES, PAGE_LIMIT, PAGE_OFFSET,
    MAIL_FOLDER, PIPELINE_DOMAINS, RUN1_BEFORE, RUN1_TS, RUN2_TS, SHEET_FILE, SINCE_DAYS, STORED_THRESHOLD, SPLIT_SEED, TEST_SIZE,
)

SQL: dict[str, str] = {}
TS = "'%Y-%m-%d %H:%M:%S'"


def sql(name: str, text: str) -> None:
    SQL[name] = text


_allowed_all, _ = O.sender_check("from_header")
sql("sender_top_domains", O.with_messages() + f"""
SELECT {O.sender_domain('from_header')} AS domain, count(*) AS n_messages, min(seq) AS first_seq
FROM messages WHERE {_allowed_all}
GROUP BY 1 ORDER BY n_messages DESC, first_seq ASC LIMIT 10""")

sql("sender_domain", O.with_messages() + f"SELECT seq, {O.sender_domain('from_header')} AS sender_domain FROM messages")

_allowed, _reason = O.sender_check("from_header", ALLOWED_DOMAINS)
sql("allowed_sender", O.with_messages() + f"SELECT seq, {_allowed} AS allowed, {_reason} AS reason FROM messages")

# what each of the odd forms says, form by form
sql("odd_addresses", O.with_messages() + """
SELECT seq, replace(a, '#', CAST(seq AS VARCHAR)) AS address, CASE WHEN contains(a, '@') THEN 'd1.example' END AS domain, name,
       contains(a, '@') AS allowed
FROM (SELECT seq,
  CASE (seq // 2) % 12 WHEN 0 THEN 'a#@d1.example' WHEN 1 THEN '"a b#"@d1.example' WHEN 2 THEN 'm#@d1.example' WHEN 3 THEN 'm#@d1.example'
    WHEN 4 THEN 'm#@d1.example' WHEN 5 THEN 'm#@d1.example' WHEN 9 THEN 'q#@D1.example' WHEN 11 THEN 'q#@d1.example' ELSE '' END AS a,
  CASE (seq // 2) % 12 WHEN 2 THEN 'Mia' WHEN 3 THEN 'Rossi Mia' WHEN 4 THEN 'Mia Neri' WHEN 5 THEN 'unclosed' WHEN 9 THEN 'Neri, Q'
    WHEN 11 THEN 'Sig. (Q) Neri' ELSE '' END AS name FROM messages)""")

sql("since_days", O.with_messages() + f"""
SELECT seq, strftime(received_date, '%Y-%m-%d') AS received_date FROM messages
WHERE received_date >= DATE '{AS_OF_DATE}' - INTERVAL {SINCE_DAYS} DAY""")

_PAGES = ("WITH pg AS (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN "
          "' <p>Caff&egrave; &#233; &euro;5, 1 < 2 and 3 > 2</p>' ELSE '' END AS html FROM pages) ")
sql("plain_text", _PAGES + f"SELECT page_id, {O.plain_text('html')} AS plain_text FROM pg")
sql("excerpt", _PAGES + f"SELECT page_id, {O.excerpt('html')} AS excerpt FROM pg")
sql("received_at", O.with_messages() + f"SELECT seq, {O.received_at_str('date_header')} AS received_at FROM messages")
sql("odd_dates", O.with_messages() + """
SELECT seq, replace(CASE (seq // 2) % 8 WHEN 0 THEN '2024-01-# 09:30:00' WHEN 1 THEN '2024-01-# 08:30:15' WHEN 2 THEN '2024-01-# 09:30:00'
    WHEN 3 THEN '2024-01-# 09:30:00' WHEN 5 THEN '2024-09-# 13:30:00' WHEN 7 THEN '2024-01-# 23:59:00' END,
  '#', lpad(CAST(seq % 28 + 1 AS VARCHAR), 2, '0')) AS received_at FROM messages""")
sql("combine_text", O.with_messages() + f"SELECT seq, {O.combine_text('subject', 'body')} AS combined FROM messages")
sql("label_sanitize", O.with_messages() + f"""
SELECT seq, {O.sanitize_folder('folder')} AS folder_label,
       {O.sanitize_domain(O.sender_domain('from_header'))} AS domain_label FROM messages""")

sql("rule_tokens", O.with_messages() + f"""
SELECT seq, array_to_string(t, ' ') AS tokens, cast(len(t) AS int) AS n_tokens
FROM (SELECT seq, {O.rule_tokens('body')} AS t FROM messages)""")
sql("segment_score", O.with_messages() + f"""
SELECT seq, {O.segment_score('subject')} AS subject_score, {O.segment_score('body')} AS body_score FROM messages""")
sql("rule_score", O.with_messages() + f"SELECT seq, {O.rule_score()} AS rule_score FROM messages")
sql("rule_leads", O.with_messages() + f"""
SELECT seq, rule_score FROM (SELECT seq, {O.rule_score()} AS rule_score FROM messages) WHERE rule_score >= 2.0""")

_neg = compile_lexicon(negative_keywords=NEGATIVE_PHRASES)
sql("negative_veto", O.with_messages() + f"""
SELECT seq, {O.negative_veto("coalesce(nullif(subject, ''), '')", 'body', O.other_headers(), _neg)} AS vetoed,
       {O.rule_score(lex=_neg)} AS rule_score FROM messages""")

# ---------------------------------------------------------------------------
# contact extraction
# ---------------------------------------------------------------------------

sql("extract_email", O.with_messages() + f"""
SELECT seq, coalesce({O.header_email()}, {O.body_email('body')}) AS email FROM messages""")

_np = O.name_parts(O.display_name('from_header'))
sql("split_name", O.with_messages() + f"""
SELECT seq, {O.first_name_of('p')} AS first_name, {O.last_name_of('p')} AS last_name
FROM (SELECT seq, {_np} AS p FROM messages)""")

sql("phone_candidates", O.with_messages(O.phone_ctes()) + """
SELECT seq, cast(li AS int) AS line, cast(pos AS int) AS pos, cast(score AS int) AS score, raw, number FROM pc""")

sql("normalize_phone", O.with_messages() + f"""
SELECT seq, cast(x.pos AS int) AS pos, x.raw AS raw, {O.normalize_phone('x.raw')} AS number FROM (
  SELECT seq, unnest(list_transform(regexp_extract_all(body, {O.q(O.P.PHONE)}), lambda r, j: {{'raw': r, 'pos': j - 1}})) AS x
  FROM messages)""")

sql("phone_label_score", O.with_messages(O.phone_ctes()) + f"""
SELECT seq, cast(li AS int) AS line_no, cast({O.phone_label_score('line')} AS int) AS score, {O.fax_only('line')} AS fax_only
FROM pl""")

sql("best_phone", O.with_messages(O.phone_ctes()) + "SELECT seq, phone FROM bp")

sql("company_phrase", O.with_messages(O.company_phrase_cte()) + "SELECT seq, company, name FROM cp")

sql("clean_company", O.with_messages() + f"""
SELECT seq, {O.clean_company(O.org_from_lines('body'))} AS clean_org,
       {O.clean_company('subject')} AS clean_subject FROM messages""")

sql("org_from_line", O.with_messages() + f"SELECT seq, {O.org_from_lines('body')} AS org FROM messages")

sql("parse_contact", O.with_messages(*O.parse_ctes()) + "SELECT seq, first_name, last_name, email, phone, org FROM pcf")

# ---------------------------------------------------------------------------
# classifier
# ---------------------------------------------------------------------------


_FEATS = ["urgency_score", "has_greeting", "question_density", "length_score", "has_contact_info", "signature_score"]

sql("ml_tokens", O.with_messages(O.MSG_TEXT_CTE) + f"""
SELECT id AS seq, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INT) AS n_tokens
FROM (SELECT id, {O.ml_tokens('text')} AS t FROM mt)""")

sql("bigrams", O.with_messages(O.MSG_TEXT_CTE) + f"""
SELECT id AS seq, array_to_string(b, '|') AS bigrams, CAST(len(b) AS INT) AS n_bigrams
FROM (SELECT id, {O.bigrams('t')} AS b FROM (SELECT id, {O.ml_tokens('text')} AS t FROM mt))""")

sql("text_features", O.with_messages(O.MSG_TEXT_CTE) + f"""
SELECT id AS seq, {', '.join(f'round({f}, 6) AS {f}' for f in _FEATS)}
FROM (SELECT id, {O.feature_cols('text')} FROM mt)""")

_ft = " || ".join(
    f"CASE WHEN {f} > 0 THEN list_transform(range(greatest(CAST(round_even({f} * 3, 0) AS INT), 1)), lambda i: '__feat_{f}') "
    f"ELSE []::varchar[] END" for f in _FEATS)
sql("feature_tokens", O.with_messages(O.MSG_TEXT_CTE) + f"""
SELECT id AS seq, array_to_string({_ft}, ' ') AS feature_tokens FROM (SELECT id, {O.feature_cols('text')} FROM mt)""")

sql("class_term_counts", O.with_messages(O.LABELLED_CTE, O.nb_ctes("lm", "lm")) + """
SELECT kind, term, n_pos, n_neg FROM nb_terms""")

sql("nb_stats", O.with_messages(O.LABELLED_CTE, O.nb_ctes("lm", "lm")) + """
SELECT stat, round(value, 6) AS value FROM (
  SELECT 'prior_pos' AS stat, prior_pos AS value FROM nb_st UNION ALL
  SELECT 'prior_neg', prior_neg FROM nb_st UNION ALL
  SELECT 'total_pos', CAST(total_pos AS DOUBLE) FROM nb_st UNION ALL
  SELECT 'total_neg', CAST(total_neg AS DOUBLE) FROM nb_st UNION ALL
  SELECT 'vocabulary_size', CAST(v AS DOUBLE) FROM nb_st)""")

sql("feature_weights", O.with_messages(O.LABELLED_CTE, O.nb_ctes("lm", "lm")) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(w_{f}, 6) AS weight FROM nb_w" for f in _FEATS))

_nb_all = [O.LABELLED_CTE, O.MSG_TEXT_CTE, O.nb_ctes("lm", "mt")]
sql("nb_score", O.with_messages(*_nb_all) + "SELECT id AS seq, round(score, 6) AS nb_score FROM nb_sc")
sql("nb_decision", O.with_messages(*_nb_all) + "SELECT id AS seq, score >= 0.5 AS is_lead FROM nb_sc")
sql("confidence_band", O.with_messages(*_nb_all) + f"SELECT id AS seq, {O.confidence_band('score')} AS confidence FROM nb_sc")

sql("stratified_split", O.with_messages(O.LABELLED_CTE, O.split_cte(TEST_SIZE, SPLIT_SEED)) + """
SELECT id, label, split_rank, is_train, is_test FROM sp""")

_ev = O.split_scored_ctes(TEST_SIZE, SPLIT_SEED) + [O.curve_ctes()]
sql("confusion", O.with_messages(*_ev) + "SELECT tp, fp, tn, fn FROM conf")
sql("classif_metrics", O.with_messages(*_ev) + """
SELECT tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, overfit FROM met2""")
sql("roc_curve", O.with_messages(*_ev) + """
SELECT point, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""")
sql("roc_auc", O.with_messages(*_ev) + "SELECT round(roc_auc, 6) AS roc_auc FROM auc")
sql("pr_curve", O.with_messages(*_ev) + """
SELECT CAST(point AS BIGINT) AS point, round(score, 6) AS threshold, round(CAST(ctp AS DOUBLE) / (ctp + cfp), 6) AS precision,
       round(CAST(ctp AS DOUBLE) / pos, 6) AS recall FROM cc, ctot
UNION ALL SELECT CAST(0 AS BIGINT), NULL, 1.0, 0.0""")
_ev_stored = O.split_scored_ctes(TEST_SIZE, SPLIT_SEED) + [O.curve_ctes(STORED_THRESHOLD)]
sql("evaluate_model", O.with_messages(*_ev_stored) + """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, accuracy AS value FROM met2 UNION ALL SELECT 'precision', precision FROM met2 UNION ALL
  SELECT 'recall', recall FROM met2 UNION ALL SELECT 'f1', f1 FROM met2 UNION ALL
  SELECT 'tp', CAST(tp AS DOUBLE) FROM met2 UNION ALL SELECT 'fp', CAST(fp AS DOUBLE) FROM met2 UNION ALL
  SELECT 'tn', CAST(tn AS DOUBLE) FROM met2 UNION ALL SELECT 'fn', CAST(fn AS DOUBLE) FROM met2 UNION ALL
  SELECT 'overfit', CASE WHEN overfit THEN 1.0 ELSE 0.0 END FROM met2 UNION ALL
  SELECT 'roc_auc', roc_auc FROM auc)""")

sql("evaluation_curves", O.with_messages(*_ev) + """
SELECT 'roc' AS curve, point, round(threshold, 6) AS threshold, round(fpr, 6) AS x, round(tpr, 6) AS y FROM roc
UNION ALL SELECT 'pr', CAST(point AS BIGINT), round(score, 6), round(CAST(ctp AS DOUBLE) / pos, 6),
  round(CAST(ctp AS DOUBLE) / (ctp + cfp), 6) FROM cc, ctot
UNION ALL SELECT 'pr', CAST(0 AS BIGINT), NULL, 0.0, 1.0""")

# ---------------------------------------------------------------------------
# ensemble
# ---------------------------------------------------------------------------

_E = O.ens_ctes()
sql("ensemble_score", O.with_messages(*_E) + "SELECT seq, round(score, 6) AS score, confidence, method FROM ee")
sql("ensemble_rule_only", O.with_messages() + f"""
SELECT seq, round(least(r / 2.0, 1.0), 6) AS score, CASE WHEN least(r / 2.0, 1.0) > 0.5 THEN 'medium' ELSE 'low' END AS confidence,
       'rule_based' AS method FROM (SELECT seq, {O.rule_score()} AS r FROM messages)""")
sql("ensemble_ml_only", O.with_messages(*_nb_all) + f"""
SELECT id AS seq, round(score, 6) AS score, {O.confidence_band('score')} AS confidence, 'ml_only' AS method FROM nb_sc""")
sql("ensemble_decision", O.with_messages(*_E) + """
SELECT seq, score >= applied AS is_lead, round(applied, 6) AS applied_threshold FROM ed""")
sql("ensemble_explain", O.with_messages(*_E) + f"""
SELECT seq, score >= applied AS is_lead, round(score, 6) AS score, confidence, method, round(ml, 6) AS ml_score,
       {O.confidence_band('ml')} AS ml_confidence, round(rule, 6) AS rule_score, round(rule_normalized, 6) AS rule_normalized,
       round(agreement, 6) AS agreement, 0.5 AS threshold, round(applied, 6) AS applied_threshold FROM ed""")
sql("runner_strategy", O.with_messages(*_E) + f"""
SELECT seq,
  rule >= 2.0 AS rule_based_lead, round(rule, 6) AS rule_based_score, 'rule_based' AS rule_based_confidence,
  ml >= 0.5 AS ml_lead, round(ml, 6) AS ml_score, {O.confidence_band('ml')} AS ml_confidence,
  (ml >= 0.5 OR rule >= 2.0) AS hybrid_lead,
  round(CASE WHEN ml < 0.5 AND rule >= 2.0 THEN rule ELSE ml END, 6) AS hybrid_score,
  CASE WHEN ml < 0.5 AND rule >= 2.0 THEN 'rule_fallback' ELSE {O.confidence_band('ml')} END AS hybrid_confidence
FROM ee""")

# ---------------------------------------------------------------------------
# ingestion runs
# ---------------------------------------------------------------------------


_P = O.pipeline_ctes(RUN1_BEFORE, RUN1_TS, RUN2_TS, PIPELINE_DOMAINS)
_W = O.with_messages(*_P)

sql("unseen_messages", _W + "SELECT seq FROM r2s")
sql("batch_dedup", O.with_messages(
    "k AS (SELECT seq, nullif(" + O.strip("message_id") + ", '') AS mid, imap_uid AS uid FROM messages)",
    """ka AS (SELECT seq, mid, uid FROM (SELECT *, min(seq) OVER (PARTITION BY mid) AS f FROM k) WHERE mid IS NULL OR seq = f)""",
    """kb AS (SELECT seq FROM (SELECT *, min(seq) OVER (PARTITION BY uid) AS f FROM ka) WHERE uid IS NULL OR seq = f)""")
    + "SELECT seq, seq NOT IN (SELECT seq FROM kb) AS duplicate FROM k")
sql("route_outcome", _W + """
SELECT seq, outcome, CASE WHEN outcome = 'processed' THEN 'processed' ELSE 'skipped' END AS status,
  CASE WHEN outcome = 'duplicate' THEN 'duplicate' WHEN outcome = 'not_allowed' THEN allow_reason
       WHEN outcome = 'not_lead' THEN printf('Missing lead keywords (score=%.2f, conf=%s)', rule, 'rule_based')
       WHEN outcome = 'missing_email' THEN 'missing_email' END AS reason,
  CASE WHEN outcome <> 'duplicate' AND allowed THEN round(rule, 6) END AS lead_score,
  CASE WHEN outcome <> 'duplicate' AND allowed THEN 'rule_based' END AS confidence
FROM o2""")
_CC = ("id, email, first_name, last_name, phone, org, source, consent, created_at, last_message_subject, "
       "last_message_received_at, last_message_excerpt")
sql("contact_upsert", _W + f"SELECT {_CC} FROM c2")
sql("created_flag", _W + "SELECT seq, email, created FROM o2 WHERE outcome = 'processed'")
sql("ledger_rows", _W + """
SELECT seq, coalesce(mid, 'uid:' || uid, CASE WHEN outcome = 'processed' THEN sha256(email) END) AS message_id, uid AS imap_uid
FROM o2 WHERE outcome <> 'duplicate'""")
sql("contact_events", _W + f"""
SELECT seq, sha256(email) AS contact_id, 'email_inbound' AS event_type, '{RUN2_TS}' AS occurred_at,
       mid AS header_message_id, from_header AS header_from, email AS extracted_email, phone AS extracted_phone,
       org AS extracted_org, received_iso AS received_at, excerpt AS body_excerpt
FROM o2 WHERE outcome = 'processed'""")
_LEADS = (f"seq, '{{ts}}' AS inserted_at, email, first_name, last_name, org AS company, phone, subject_h AS subject, "
          f"received_at, excerpt AS notes")
sql("new_leads", _W + "SELECT " + _LEADS.format(ts=RUN2_TS) + " FROM leads2")
_hdrs = [h.strip() for h in LEAD_HEADERS if h.strip()]
_lead_cols = {"email": "email", "company": "org", "phone": "phone", "notes": "excerpt"}
sql("lead_projection", _W + "SELECT seq, " + ", ".join(
    _lead_cols.get(h.lower(), "CAST(NULL AS VARCHAR)") + ' AS "' + h + '"' for h in _hdrs) + " FROM leads2")
sql("contacts_export", _W + f"""
SELECT id, email, first_name, last_name, phone, org, source, consent, {O.iso('created_at')} AS created_at,
       last_message_subject, {O.iso('last_message_received_at')} AS last_message_received_at, last_message_excerpt FROM c2""")
sql("contacts_page", _W + f"SELECT {_CC} FROM c2 ORDER BY created_at, id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}")
sql("contacts_next_page", _W + f"SELECT {_CC} FROM c2 ORDER BY created_at, id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET + PAGE_LIMIT}")
sql("run_stats", _W + """
SELECT count(*) AS total, count(*) FILTER (WHERE outcome IN ('processed', 'missing_email')) AS processed,
       count(*) FILTER (WHERE created) AS new_leads, count(*) FILTER (WHERE outcome <> 'processed') AS skipped FROM o2""")
sql("metrics_snapshot", _W + f"""
, cr AS (
  SELECT 'emails_processed' AS metric, {O.sanitize_folder('folder')} AS folder, {O.sanitize_domain('from_domain')} AS domain
  FROM o2 WHERE outcome IN ('processed', 'missing_email')
  UNION ALL
  SELECT 'leads_created', {O.sanitize_folder('folder')}, {O.sanitize_domain('from_domain')} FROM o2 WHERE created)
SELECT metric, domain, count(*) AS value FROM cr GROUP BY metric, domain
UNION ALL SELECT metric, '__total__', count(*) FROM cr GROUP BY metric""".replace("\\n, cr AS", ", cr AS", 1))
sql("metrics_by_folder", _W + f"""
, cr AS (
  SELECT outcome, created, {O.sanitize_domain('from_domain')} AS domain FROM o2
  WHERE {O.sanitize_folder('folder')} = '{METRICS_FOLDER}'),
cm AS (SELECT 'emails_processed' AS metric, domain FROM cr WHERE outcome IN ('processed', 'missing_email')
       UNION ALL SELECT 'leads_created', domain FROM cr WHERE created)
SELECT metric, domain, count(*) AS value FROM cm GROUP BY metric, domain
UNION ALL SELECT metric, '__total__', count(*) FROM cm GROUP BY metric""")
_SHEET = ("sheet AS (SELECT 1 AS run, seq, email, org AS company FROM leads1 "
          "UNION ALL SELECT 2, seq, email, org FROM leads2)")
sql("lead_summary", O.with_messages(*_P, _SHEET) + """
SELECT count(*) AS total_leads, count(DISTINCT CASE WHEN lower(trim(company)) <> '' THEN lower(trim(company)) END) AS unique_companies
FROM sheet""")
sql("top_domains", O.with_messages(*_P, _SHEET) + f"""
SELECT domain, leads, first.run AS first_run, first.seq AS first_seen FROM (
SELECT domain, count(*) AS leads, min({{'run': run, 'seq': seq}}) AS first FROM (
  SELECT run, seq, CASE WHEN contains(lower({O.strip('email')}), '@') THEN
    regexp_extract(lower({O.strip('email')}), '([^@]*)$', 1) END AS domain FROM sheet)
WHERE domain IS NOT NULL GROUP BY domain) ORDER BY leads DESC, first_run, first_seen LIMIT 10""")
sql("discovered_gauge", O.with_messages() + f"""
SELECT {O.sanitize_folder('folder')} AS folder, count(*) AS discovered FROM messages GROUP BY 1""")
sql("run_progress", _W + """
SELECT seq,
  sum(CASE WHEN outcome IN ('processed', 'missing_email') THEN 1 ELSE 0 END) OVER w AS processed,
  sum(CASE WHEN outcome <> 'processed' THEN 1 ELSE 0 END) OVER w AS skipped,
  sum(CASE WHEN created THEN 1 ELSE 0 END) OVER w AS leads,
  outcome IN ('processed', 'missing_email') AS legacy_emit
FROM o2 WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
sql("outcome_counts", _W + "SELECT outcome, count(*) AS n FROM o2 GROUP BY outcome")

# ---------------------------------------------------------------------------
# sources, coercion, notices
# ---------------------------------------------------------------------------

_SPECIALS = r'[()<>@,:;.\\"\[\]]'
# a From header as the mail parser writes it
_PARSED_FROM = f"""CASE WHEN from_header = '' THEN NULL
       WHEN starts_with(from_header, '"') OR contains(from_header, ',') THEN from_header
       WHEN ends_with(from_header, ')') THEN split_part(from_header, ' (', 1)  -- the header parser drops comments
       WHEN regexp_matches(from_header, '^([^<]*[^ <]) <([^<>]*)>$')
            AND regexp_matches(regexp_extract(from_header, '^([^<]*[^ <]) <', 1), {O.q(_SPECIALS)})
       THEN '"' || regexp_extract(from_header, '^([^<]*[^ <]) <', 1) || '" <' || regexp_extract(from_header, '<([^<>]*)>$', 1) || '>'
       ELSE from_header END"""
sql("eml_load", O.with_messages() + f"""
SELECT CAST(seq AS VARCHAR) AS path, nullif(message_id, '') AS message_id, {_PARSED_FROM} AS from_header,
  nullif(subject, '') AS subject, {O.received_at_str('date_header')} AS received_at, {O.strip('body')} AS body
FROM messages""")

# raw mail to contacts: one run; names and addresses come from Reply-To where there is one
_MAIL_ALLOWED, _MAIL_REASON = O.sender_check("sender", PIPELINE_DOMAINS)
_MAIL = "WITH raw AS (" + O.with_messages() + f"""SELECT * FROM messages),
headed AS (SELECT seq, nullif(message_id, '') AS message_id, {_PARSED_FROM} AS sender,
    CASE WHEN seq % 4 = 0 THEN 'Vendite <vendite' || ((seq // 2) % 31) || '@ours.example>' END AS to_header,
    CASE WHEN seq % 29 = 0 THEN 'Sara Blu <sara' || ((seq // 2) % 31) || '@risposte.example>' END AS reply_to,
    subject, {O.strip('body')} AS body, date_header FROM raw WHERE seq % 83 <> 0),
messages AS (SELECT *, coalesce(reply_to, sender) AS from_header FROM headed),
""" + ",\n".join(c.strip() for c in O.parse_ctes()) + f""",
mo AS (SELECT m.*, p.email, p.first_name, p.last_name, p.phone, p.org,
    m.message_id IS NOT NULL AND m.seq <> min(m.seq) OVER (PARTITION BY m.message_id) AS duplicate,
    {O.rule_score(others="concat_ws(' ', m.message_id, m.sender, m.to_header, m.reply_to, m.date_header)", subject='m.subject', body='m.body')} AS rule,
    {_MAIL_ALLOWED} AS allowed, {_MAIL_REASON} AS allow_reason, {O.sender_domain('sender')} AS domain,
    {O.received_at_str('m.date_header')} AS received_at, {O.excerpt('m.body')} AS excerpt
  FROM messages m JOIN pcf p ON m.seq = p.seq),
mr AS (SELECT *, CASE WHEN duplicate THEN 'duplicate' WHEN NOT allowed THEN 'not_allowed' WHEN rule < 2.0 THEN 'not_lead'
    WHEN email IS NULL THEN 'missing_email' ELSE 'processed' END AS outcome FROM mo)
"""
_MAIL_FIRST = lambda f: f"arg_min({f}, seq) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS {f}"
sql("mail_contacts", _MAIL + f"""
SELECT sha256(email) AS id, email, {', '.join(_MAIL_FIRST(f) for f in ('first_name', 'last_name', 'phone', 'org'))},
       'email' AS source, false AS consent, '{RUN2_TS}' AS created_at,
       arg_max(subject, seq) FILTER (WHERE subject <> '') AS last_message_subject,
       arg_max(received_at, seq) FILTER (WHERE received_at IS NOT NULL) AS last_message_received_at,
       arg_max(excerpt, seq) AS last_message_excerpt
FROM mr WHERE outcome = 'processed' GROUP BY email""")
sql("mail_events", _MAIL + """
SELECT seq, sha256(email) AS contact_id, message_id AS header_message_id, sender AS header_from, to_header AS header_to,
       reply_to AS header_reply_to, nullif(subject, '') AS header_subject, received_at,
       email AS extracted_email, first_name AS extracted_first_name
FROM mr WHERE outcome = 'processed'""")
sql("mail_outcomes", _MAIL + f"""
SELECT seq, '{MAIL_FOLDER}' AS folder, outcome, CASE WHEN outcome = 'processed' THEN 'processed' ELSE 'skipped' END AS status,
  CASE WHEN outcome = 'duplicate' THEN 'duplicate' WHEN outcome = 'not_allowed' THEN allow_reason
       WHEN outcome = 'not_lead' THEN printf('Missing lead keywords (score=%.2f, conf=%s)', rule, 'rule_based')
       WHEN outcome = 'missing_email' THEN 'missing_email' END AS reason FROM mr
UNION ALL SELECT seq, '{MAIL_FOLDER}', 'error', 'error',
  CASE WHEN seq % 3 = 2 THEN 'mail has no headers' ELSE 'mail has no content' END FROM raw WHERE seq % 83 = 0""")
sql("mail_metrics", _MAIL + f"""
, lead1 AS (SELECT min(seq) AS seq FROM mr WHERE outcome = 'processed' GROUP BY email),
mc AS (SELECT 'emails_processed' AS metric, {O.sanitize_domain('domain')} AS domain FROM mr WHERE outcome IN ('processed', 'missing_email')
       UNION ALL SELECT 'leads_created', {O.sanitize_domain('domain')} FROM mr JOIN lead1 USING (seq)
       UNION ALL SELECT 'errors', 'unknown' FROM raw WHERE seq % 83 = 0)
SELECT metric, '{MAIL_FOLDER}' AS folder, domain, count(*) AS value FROM mc GROUP BY ALL""")

_LINES = """ll AS (
  SELECT seq, CASE WHEN seq % 83 = 0 THEN ''
    WHEN seq % 97 = 0 THEN substr(CAST(to_json({'label': label, 'subject': subject, 'body': body}) AS VARCHAR), 1,
                                  CAST(length(CAST(to_json({'label': label, 'subject': subject, 'body': body}) AS VARCHAR)) / 2 AS INT))
    WHEN seq % 89 = 0 THEN CAST(to_json({'subject': subject, 'body': body}) AS VARCHAR)
    ELSE CAST(to_json({'label': label, 'subject': subject, 'body': body}) AS VARCHAR) END AS value
  FROM m WHERE label IS NOT NULL)"""
sql("label_check", O.with_messages(_LINES, """lk AS (
  SELECT value, trim(value) = '' AS blank, CASE WHEN trim(value) <> '' THEN json_valid(value) ELSE false END AS ok,
         CASE WHEN trim(value) <> '' AND json_valid(value) THEN json_extract(value, '$.label') END AS lbl FROM ll)""") + """
SELECT count(*) AS lines, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE NOT blank AND NOT ok) AS invalid,
  count(*) FILTER (WHERE ok AND lbl IS NULL) AS missing_label,
  count(*) FILTER (WHERE ok AND lbl IS NOT NULL) AS records,
  count(*) FILTER (WHERE ok AND CAST(lbl AS INT) = 1) AS positives
FROM lk""")

sql("nb_model_terms", SQL["class_term_counts"])

sql("legacy_model_terms", O.with_messages(O.LABELLED_CTE, f"""
lt AS (SELECT id // {LEGACY_SPAN} AS model, label, {O.ml_tokens('text')} AS t FROM lm),
lk AS (SELECT model, label, 'uni' AS kind, unnest(t) AS term FROM lt UNION ALL
       SELECT model, label, 'bi', unnest({O.bigrams('t')}) FROM lt)""") + """
SELECT model, kind, term, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
FROM lk GROUP BY model, kind, term""")

sql("coerce_ts", """
WITH x AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'garbage-' || CAST(event_id AS VARCHAR)
    WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    ELSE CAST(ts AS VARCHAR) END AS raw FROM events),
y AS (SELECT event_id, raw, CASE WHEN regexp_matches(raw, '[+-][0-9]{2}:[0-9]{2}$') THEN timezone('UTC', try_cast(raw AS TIMESTAMPTZ))
                                 ELSE try_cast(raw AS TIMESTAMP) END AS c FROM x)
SELECT event_id, coalesce(strftime(c, '%Y-%m-%d %H:%M:%S.%f'), raw) AS value, c IS NOT NULL AS parsed FROM y""")

sql("lead_outbox", _W.rstrip() + f""",
lo AS (SELECT * FROM leads2)
SELECT seq, coalesce(nullif(subject_h, ''), 'Nuovo lead ricevuto') AS subject,
  'Nuovo lead inserito automaticamente:' || chr(10) || 'Nome: ' || coalesce(first_name, '') || ' ' || coalesce(last_name, '')
  || chr(10) || 'Email: ' || coalesce(email, '') || chr(10) || 'Azienda: ' || coalesce(org, '') || chr(10)
  || 'Telefono: ' || coalesce(phone, '') || chr(10) || 'Ricevuto alle: ' || coalesce(received_iso, '') || chr(10) || chr(10)
  || coalesce(excerpt, '') AS body
FROM lo""")

sql("sheet_notice", _W + f"""
SELECT seq, 'AVVISO: è stato aggiunto un cliente al foglio excel!' AS subject, concat_ws(chr(10),
  'AVVISO: è stato aggiunto un cliente al foglio excel!', '', 'Email cliente: ' || coalesce(email, ''),
  'Nome: ' || coalesce(first_name, '') || ' ' || coalesce(last_name, ''), 'Azienda: ' || coalesce(org, ''),
  'Telefono: ' || coalesce(phone, ''), 'File Excel: {SHEET_FILE}',
  'Riga inserita: ' || (1 + (SELECT count(*) FROM leads1) + row_number() OVER (ORDER BY seq)),
  'Aggiornato alle: {RUN2_TS.replace(" ", "T")}', '', 'Estratto nota:', coalesce(excerpt, '')) AS body
FROM leads2""")

sql("events_json", _W + """
SELECT o2.seq, sha256(o2.email) AS contact_id, o2.mid AS header_message_id, m.date_header AS header_date,
       o2.subject_h AS header_subject, o2.email AS extracted_email, o2.first_name AS extracted_first_name,
       o2.received_iso AS received_at, o2.excerpt AS body_excerpt, true AS keeps_null_headers
FROM o2 JOIN messages m ON o2.seq = m.seq WHERE o2.outcome = 'processed'""")

# ---------------------------------------------------------------------------
# augmentation and tf-idf
# ---------------------------------------------------------------------------

sql("augment", O.with_messages(O.LABELLED_CTE) + O.augment_sql())
sql("tfidf_weights", O.with_messages(O.LABELLED_CTE, f"""
dt AS (SELECT id, {O.ml_tokens('text')} AS t FROM lm),
dtb AS (SELECT id, t || {O.bigrams('t')} AS terms FROM dt),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM dtb) GROUP BY id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nd AS (SELECT count(DISTINCT id) AS n FROM lm),
raw AS (SELECT tf.id, tf.term, tf.tf * (ln((1.0 + nd.n) / (1.0 + dfq.df)) + 1.0) AS r FROM tf JOIN dfq USING (term) CROSS JOIN nd)""") + """
SELECT id, term, round(CASE WHEN sqrt(sum(r * r) OVER (PARTITION BY id)) > 0 THEN r / sqrt(sum(r * r) OVER (PARTITION BY id)) ELSE 0.0 END, 6) AS weight
FROM raw""")

# The fit on its own terms: the weights at the minimum are a combination of the training rows, so the model is found
# over the rows' dot products, by accelerated gradient steps on one row of lists instead of L-BFGS over a table of terms.
_LOGREG = O.with_messages(O.LABELLED_CTE, O.split_cte(TEST_SIZE, SPLIT_SEED), f"""
dt AS (SELECT id, {O.ml_tokens('text')} AS t FROM lm),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t || {O.bigrams('t')}) AS term FROM dt) GROUP BY id, term),
rows_n AS (SELECT id, label, row_number() OVER (ORDER BY id) AS i FROM sp WHERE is_train),
nd AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1 FROM rows_n),
dfq AS (SELECT term, ln((1.0 + any_value(nd.n)) / (1.0 + count(*))) + 1.0 AS idf
        FROM tf JOIN rows_n USING (id) CROSS JOIN nd GROUP BY term),
tx AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS x FROM tf JOIN dfq USING (term)),
fx AS (SELECT id, [{', '.join(_FEATS)}]::DOUBLE[] AS f FROM (SELECT id, {O.feature_cols('text')} FROM lm)),
terms_dot AS (SELECT a.id, r.i, sum(a.x * b.x) AS d FROM tx a JOIN tx b USING (term) JOIN rows_n r ON r.id = b.id GROUP BY a.id, r.i),
dots AS (SELECT a.id, list(coalesce(t.d, 0.0) + list_dot_product(a.f, b.f) ORDER BY r.i) AS k
         FROM fx a CROSS JOIN rows_n r JOIN fx b ON b.id = r.id LEFT JOIN terms_dot t ON t.id = a.id AND t.i = r.i GROUP BY a.id),
data AS (SELECT list(k ORDER BY i) AS m, list(CAST(label AS DOUBLE) ORDER BY i) AS y,
                list(CASE WHEN label = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END ORDER BY i) AS s
         FROM rows_n JOIN dots USING (id) CROSS JOIN nd),
sized AS (SELECT *, 1.0 + list_max(list_transform(m, lambda k: list_sum(k) + len(k))) * list_max(s) / 4 AS steep FROM data),
pace AS (SELECT *, (sqrt(steep) - 1) / (sqrt(steep) + 1) AS push FROM sized)""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
fitted AS (
  SELECT 0 AS turn, list_transform(y, lambda v: 0.0::DOUBLE) AS a, list_transform(y, lambda v: 0.0::DOUBLE) AS a0,
         0.0::DOUBLE AS b, 0.0::DOUBLE AS b0 FROM data
  UNION ALL
  SELECT turn + 1, list_transform(range(1, len(r) + 1), lambda i: v[i] - (v[i] + r[i]) / steep), a, vb - list_sum(r) / steep, b
  FROM (SELECT turn, a, b, v, vb, steep, list_transform(range(1, len(v) + 1), lambda i:
               s[i] * (1 / (1 + exp(-(list_dot_product(m[i], v) + vb))) - y[i])) AS r
        FROM (SELECT turn, a, b, steep, m, s, y, b + push * (b - b0) AS vb,
                     list_transform(range(1, len(a) + 1), lambda i: a[i] + push * (a[i] - a0[i])) AS v
              FROM fitted CROSS JOIN pace WHERE turn < 800)))
"""
sql("logreg_scores", _LOGREG + """
SELECT tst.id, tst.label, round(1 / (1 + exp(-(list_dot_product(dots.k, fitted.a) + fitted.b))), 3) AS score
FROM tst JOIN dots ON dots.id = tst.id CROSS JOIN fitted WHERE fitted.turn = 800""")

# ---------------------------------------------------------------------------
# streaming (stated as one run over all mail: the stream must agree with it)
# ---------------------------------------------------------------------------

_S = O.with_messages(*O.pipeline_ctes("1900-01-01", RUN1_TS, RUN2_TS, PIPELINE_DOMAINS))
sql("stream_contacts", _S + """
SELECT email, first_name, last_name, phone, org, last_message_subject, last_message_received_at, last_message_excerpt FROM c2""")
sql("stream_totals", _S + f"""
SELECT {O.sanitize_folder('folder')} AS folder, {O.sanitize_domain('from_domain')} AS domain,
       count(*) FILTER (WHERE outcome IN ('processed', 'missing_email')) AS processed,
       count(*) FILTER (WHERE created) AS leads
FROM o2 GROUP BY 1, 2""")
sql("stream_watermark_dedup", O.with_messages() + f"""
SELECT DISTINCT coalesce(nullif({O.strip('message_id')}, ''), 'uid:' || imap_uid) AS key, CAST(1 AS BIGINT) AS n FROM messages""")
sql("stream_replay", _S + """
SELECT count(*) AS ledger_rows, CAST(0 AS BIGINT) AS replay_ledger_rows, count(*) AS ledger_rows_before,
  (SELECT count(*) FROM messages) AS replay_rows, CAST(0 AS BIGINT) AS replay_not_duplicate
FROM o2 WHERE outcome <> 'duplicate'""")
