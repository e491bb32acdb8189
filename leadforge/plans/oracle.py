"""DuckDB SQL that states each registered query independently of Spark.

The expression builders here mirror the operator semantics in plain SQL
(RE2 regexes, DuckDB list lambdas). They share only configuration values and
regex text with the Spark side, never code paths.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.patterns import EMAIL, FEATURE_PHONE, LINE_BREAK, ML_TOKEN, PHONE, RULE_NON_WORD, WS, sql_str
from ..operators.rules import DEFAULT_LEXICON, Lexicon

q = sql_str


def lit_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# ---------------------------------------------------------------------------
# messages batch (same plan as sources.tables.messages)
# ---------------------------------------------------------------------------

MESSAGES_CTE = """
lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
base AS (
  SELECT d.doc_id AS seq, d.text, l.quality AS label,
         cast(d.doc_id % 31 AS varchar) AS u, cast(d.doc_id AS varchar) AS sid,
         'd' || cast(d.doc_id % 11 AS varchar) || '.example' AS dom,
         split_part(d.text, chr(10), 1) AS line1
  FROM documents d LEFT JOIN lab l ON d.doc_id = l.doc_id),
m0 AS (
  SELECT seq,
    CASE WHEN seq % 41 = 0 THEN '' ELSE '<m' || sid || '@' || dom || '>' END AS message_id,
    sid AS imap_uid,
    CASE WHEN seq % 3 = 0 THEN 'Sales' ELSE 'INBOX' END AS folder,
    CASE WHEN seq % 53 = 0 THEN 'not-an-email'
         WHEN seq % 59 = 0 THEN 'Undisclosed <>'
         WHEN seq % 61 = 0 THEN 'mario' || u || '@' || dom || ' (Mario Rossi)'
         WHEN seq % 67 = 0 THEN 'prima' || u || '@' || dom || ', Carla <carla@altra.example>'
         WHEN seq % 71 = 0 THEN '"Rossi, Mario <vendite>" <quoted' || u || '@' || dom || '>'
         ELSE 'Dr. Mario Rossi' || u || ' <User' || u || '@' || upper(dom) || '>' END AS from_header,
    CASE WHEN seq % 7 = 0 THEN 'Richiesta preventivo' WHEN seq % 7 = 1 THEN 'Quote request for services'
         WHEN seq % 7 = 2 THEN 'Richiesta informazioni' ELSE line1 END AS subject,
    text ||
    CASE WHEN seq % 13 = 3 THEN chr(10) || 'Sono Giulia Verdi' || u || ' della Verdi Costruzioni S.p.A.'
         WHEN seq % 13 = 5 THEN chr(10) || 'Mi chiamo Luca Neri e lavoro presso Neri Logistica, scrivete a luca.neri' || u || '@neri-logistica.example'
         WHEN seq % 13 = 7 THEN chr(10) || 'Lavoro per il team marketing'
         WHEN seq % 13 = 9 THEN chr(10) || 'La nostra azienda si chiama Bianchi & Figli'
         WHEN seq % 13 = 11 THEN chr(10) || 'sono marco di ufficio'
         ELSE '' END ||
    CASE WHEN seq % 5 = 0 THEN chr(10) || 'Tel. ufficio: +39 02 1234' || lpad(u, 3, '0') || chr(10) || 'Cell: +39 345 987 6' || lpad(u, 3, '0') || chr(10) || 'Azienda: Rossi Impianti S.r.l.'
         WHEN seq % 5 = 1 THEN chr(10) || 'Phone: +33 1 44 55 66 77' || chr(10) || 'Fax: +33 1 44 55 66 78' || chr(10) || 'Company - Nouvelle Energie S.A.S.'
         WHEN seq % 5 = 2 THEN chr(10) || 'Buongiorno, vorremmo una quotazione e un offerta dettagliata?'
         ELSE '' END AS body,
    date '2024-01-01' + cast(seq % 30 AS int) AS received_date, label
  FROM base),
m AS (
  SELECT seq * 2 AS seq, message_id, imap_uid, folder, from_header, subject, body, received_date,
    CASE WHEN seq % 47 = 0 THEN 'not a date'
         WHEN seq % 43 = 2 THEN strftime(received_date, '%a, %-d %b %Y') || ' 07:08:09 GMT'
         WHEN seq % 43 = 3 THEN strftime(received_date, '%-d %b %y') || ' 07:08 EST'
         WHEN seq % 43 = 4 THEN strftime(received_date, '%a, %d %b %Y') || ' 23:59:59'
         ELSE strftime(received_date, '%a, %-d %b %Y') || ' ' || lpad(cast(seq % 24 AS varchar), 2, '0')
              || ':' || lpad(cast(seq % 60 AS varchar), 2, '0') || ':00 '
              || CASE WHEN seq % 3 = 0 THEN '+0000' WHEN seq % 3 = 1 THEN '+0100' ELSE '-0500' END
              || CASE WHEN seq % 43 = 1 THEN ' (UTC)' ELSE '' END END AS date_header,
    cast(label AS int) AS label
  FROM m0),
messages AS (
  SELECT * FROM m
  UNION ALL
  SELECT seq + 1, message_id, imap_uid, folder, from_header, subject, body, received_date, date_header, label
  FROM m WHERE seq % 20 = 0)
"""


def with_messages(*ctes: str) -> str:
    parts = [MESSAGES_CTE.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# scalar expression builders
# ---------------------------------------------------------------------------

def strip(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def norm_ws(e: str) -> str:
    return strip(f"regexp_replace({e}, {q(WS + '+')}, ' ', 'g')")


def address_of(e: str) -> str:
    """First address: what stands in the first angle brackets outside quotes, else the first list entry without comments."""
    bare = f"regexp_replace(coalesce({e}, ''), '\"[^\"]*\"', '', 'g')"
    entry = f"split_part(regexp_replace({bare}, '[(][^()]*[)]', ' ', 'g'), ',', 1)"
    return strip(f"CASE WHEN contains({entry}, '<') THEN split_part(split_part({entry}, '<', 2), '>', 1) ELSE {entry} END")


def sender_domain(e: str) -> str:
    a = f"lower({address_of(e)})"
    return f"CASE WHEN contains({a}, '@') THEN regexp_extract({a}, '([^@]*)$', 1) END"


def split_lines(e: str) -> str:
    return (
        f"CASE WHEN {e} = '' THEN []::varchar[] ELSE string_split_regex("
        f"regexp_replace({e}, {q('(?:' + LINE_BREAK + ')$')}, ''), {q(LINE_BREAK)}) END"
    )


def stem_expr(x: str, lex: Lexicon) -> str:
    whens = " ".join(f"WHEN starts_with({x}, {q(p)}) THEN {q(s)}" for p, s in lex.stems)
    return f"(CASE {whens} ELSE {x} END)"


def rule_tokens(e: str, lex: Lexicon = DEFAULT_LEXICON) -> str:
    clean = f"regexp_replace(lower(coalesce({e}, '')), {q(RULE_NON_WORD)}, ' ', 'g')"
    parts = f"list_filter(string_split_regex({clean}, {q(WS + '+')}), lambda x: x <> '')"
    kept = f"list_filter({parts}, lambda x: NOT list_contains({lit_list(lex.stopwords)}, x))"
    mp = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in lex.lookup.items()) + "}"
    st = stem_expr("x", lex)
    return f"list_transform({kept}, lambda x: coalesce(map_extract_value({mp}, {st}), {st}))"


def segment_score_tokens(toks: str, lex: Lexicon = DEFAULT_LEXICON) -> str:
    kw = f"list_filter({toks}, lambda t: list_contains({lit_list(lex.keywords)}, t))"
    joined = f"array_to_string({toks}, ' ')"
    ph = ", ".join(f"CASE WHEN contains({joined}, {q(p)}) THEN {q(c)} END" for p, c in lex.phrases)
    hits = f"list_concat({kw}, list_filter([{ph}], lambda x: x IS NOT NULL))"
    return f"cast(len(list_distinct({hits})) AS double)"


def segment_score(e: str, lex: Lexicon = DEFAULT_LEXICON) -> str:
    return segment_score_tokens(rule_tokens(e, lex), lex)


def other_headers(mid: str = "message_id", frm: str = "from_header", date: str = "date_header") -> str:
    """Non-subject header values in map order: Message-ID (null when empty), From, To (null), Date."""
    return f"concat_ws(' ', nullif({mid}, ''), {frm}, {date})"


def negative_veto(subject: str, body: str, others: str, lex: Lexicon) -> str:
    if not lex.negatives:
        return "false"
    parts = ", ".join(f"nullif(array_to_string({rule_tokens(x, lex)}, ' '), '')" for x in (subject, body, others))
    comb = f"concat_ws(' ', {parts})"
    return "(" + " OR ".join(f"contains({comb}, {q(p)})" for p in lex.negatives) + ")"


def rule_score(subject: str = "subject", body: str = "body", others: str | None = None,
               lex: Lexicon = DEFAULT_LEXICON) -> str:
    others = others or other_headers()
    subj = f"coalesce(nullif({subject}, ''), '')"
    ws, wb, wh = lex.weights
    b = f"coalesce({body}, '')"
    s = (f"({segment_score(subj, lex)} * {ws} + {segment_score(b, lex)} * {wb}"
         f" + {segment_score(others, lex)} * {wh})")
    return f"CASE WHEN {negative_veto(subj, body, others, lex)} THEN 0.0 ELSE {s} END"


def sender_check(e: str, allowed_domains=None) -> tuple[str, str]:
    raw = f"coalesce({e}, '')"
    addr = address_of(raw)
    valid = f"({addr} <> '' AND contains({addr}, '@'))"
    dom = f"lower(regexp_extract({addr}, '([^@]*)$', 1))"
    allowed_set = sorted({d.strip().lower() for d in (allowed_domains or []) if d and d.strip()})
    in_list = "true" if not allowed_set else f"({dom} IN ({', '.join(q(d) for d in allowed_set)}))"
    allowed = f"({valid} AND {in_list})"
    reason = (f"CASE WHEN NOT {valid} THEN 'Invalid sender address: ''' || {raw} || '''' "
              f"WHEN NOT {in_list} THEN 'Sender domain not allowed: ' || {dom} END")
    return allowed, reason


def plain_text(e: str) -> str:
    s = e
    for pat in [
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>",
    ]:
        s = f"regexp_replace({s}, {q(pat)}, ' ', 'g')"
    t = f"CASE WHEN contains({e}, '<') AND contains({e}, '>') THEN {s} ELSE {e} END"
    # the references that occur in the tables, spelled out on their own; a second pass only where there is markup
    found = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&copy;", "©"),
             ("&middot;", "·"), ("&egrave;", "è"), ("&#233;", "é"), ("&euro;", "€"), ("&amp;", "&")]

    def decode(x: str) -> str:
        for name, sign in found:
            x = f"replace({x}, {q(name)}, {q(sign)})"
        return x

    once = decode(t)
    return norm_ws(f"CASE WHEN contains({e}, '<') AND contains({e}, '>') THEN {decode(once)} ELSE {once} END")


def excerpt(e: str, n: int = L.BODY_EXCERPT_CHARS) -> str:
    t = plain_text(e)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {n - 1}) || '…' END"


def combine_text(s: str, b: str) -> str:
    ss, bb = f"coalesce({strip(s)}, '')", f"coalesce({strip(b)}, '')"
    return f"CASE WHEN {ss} <> '' AND {bb} <> '' THEN {ss} || chr(10) || {bb} ELSE {ss} || {bb} END"


def sanitize_folder(e: str) -> str:
    f = f"coalesce({strip(e)}, '')"
    return f"CASE WHEN {f} = '' THEN 'unknown' ELSE {f} END"


def sanitize_domain(e: str) -> str:
    d = f"coalesce(lower({strip(e)}), '')"
    return f"CASE WHEN {d} = '' THEN 'unknown' ELSE {d} END"


def date_fields(e: str) -> tuple[str, str]:
    """(local timestamp, offset as +hhmm text) of the date forms in the batch, from words counted off the line."""
    words = f"string_split(regexp_replace(regexp_replace({e}, '^[A-Za-z]{{3}}, ', ''), ' [(].*$', ''), ' ')"
    year = f"CASE WHEN length({words}[3]) = 2 THEN '20' || {words}[3] ELSE {words}[3] END"
    clock = f"CASE WHEN length({words}[4]) = 5 THEN {words}[4] || ':00' ELSE {words}[4] END"
    local = f"try_strptime({words}[1] || ' ' || {words}[2] || ' ' || ({year}) || ' ' || ({clock}), '%d %b %Y %H:%M:%S')"
    zone = f"CASE {words}[5] WHEN 'GMT' THEN '+0000' WHEN 'EST' THEN '-0500' ELSE coalesce({words}[5], '+0000') END"
    return local, zone


def received_at_str(e: str, fmt: str = "%Y-%m-%d %H:%M:%S") -> str:
    local, zone = date_fields(e)
    shift = f"(CAST(substr({zone}, 2, 2) AS INT) * 60 + CAST(substr({zone}, 4, 2) AS INT)) * (CASE WHEN starts_with({zone}, '-') THEN 1 ELSE -1 END)"
    return f"CASE WHEN {local} IS NOT NULL THEN strftime({local} + to_minutes({shift}), '{fmt}') END"


def received_iso_local(e: str) -> str:
    local, zone = date_fields(e)
    return f"CASE WHEN {local} IS NOT NULL THEN strftime({local}, '%Y-%m-%dT%H:%M:%S') || substr({zone}, 1, 3) || ':' || substr({zone}, 4, 2) END"


def confidence_band(s: str) -> str:
    return (f"CASE WHEN {s} >= 0.9 THEN 'high' WHEN {s} >= 0.7 THEN 'medium' "
            f"WHEN {s} >= 0.5 THEN 'low' ELSE 'very_low' END")


__all__ = [n for n in dir() if not n.startswith("_")]


# ---------------------------------------------------------------------------
# contact extraction (RE2: a word boundary is a consumed non-word char or an end)
# ---------------------------------------------------------------------------

from ..functions import patterns as P  # noqa: E402

_W = P.WORD_CHARS
_WSC = P.WS_CHARS
RB = f"(?:^|[^{_W}])"   # boundary before (consumes one char)
RA = f"(?:[^{_W}]|$)"   # boundary after
_NAME = rf"([{_W}'’{_WSC}.]{{2,60}}?)"
_COMPANY = rf"([{_W}&'’.,\-{_WSC}]{{3,}})"
_S = f"[{_WSC}]+"
COMPANY_PATTERNS_RE2 = [
    (rf"(?i){RB}sono{_S}{_NAME}{_S}(?:di|del|della|dell'|dello){_S}{_COMPANY}", 1, 2),
    (rf"(?i){RB}sono{_S}{_NAME}{_S}e{_S}lavoro{_S}(?:per|presso|in){_S}{_COMPANY}", 1, 2),
    (rf"(?i){RB}mi{_S}chiamo{_S}{_NAME}{_S}e{_S}(?:sono|lavoro){_S}(?:per|presso|in|di|del|della|dell'|dello){_S}{_COMPANY}", 1, 2),
    (rf"(?i){RB}lavoro{_S}(?:per|presso|in){_S}{_COMPANY}", 0, 1),
    (rf"(?i){RB}(?:azienda|società|societa|company){_S}(?:si{_S}chiama|chiamata|denominata){_S}{_COMPANY}", 0, 1),
]
LEGAL_FORM_RE2 = f"{RB}(?:{'|'.join(L.LEGAL_FORMS)}){RA}"
ORG_LABEL_PREFIX_RE2 = rf"(?i)^(?:{'|'.join(L.ORG_LABEL_WORDS)})[:\-{_WSC}]*"


EMPTY = "''"


def co(e: str) -> str:
    return f"coalesce({e}, '')"


def first_address(e: str) -> str:
    return address_of(f"coalesce({e}, '')")


def display_name(e: str) -> str:
    v = f"coalesce({e}, '')"
    return (f"CASE WHEN starts_with({v}, '\"') THEN split_part({v}, '\"', 2) "
            f"WHEN contains(split_part({v}, ',', 1), '<') THEN {strip(f"split_part({v}, '<', 1)")} "
            f"WHEN contains({v}, '(') THEN split_part(split_part({v}, '(', 2), ')', 1) ELSE '' END")


def header_email(frm: str = "from_header") -> str:
    a = first_address(frm)
    return f"nullif({a}, '')"


def body_email(e: str) -> str:
    return f"nullif(regexp_extract(coalesce({e}, ''), {q(P.EMAIL)}, 0), '')"


def name_parts(e: str) -> str:
    words = f"string_split(lower({norm_ws(co(e))}), ' ')"
    return (f"list_filter({words}, lambda w: w <> '' AND NOT list_contains({lit_list(L.NAME_TITLES)}, "
            f"regexp_replace(w, '\\.+$', '')))")


def title_case(e: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')")


def first_name_of(parts: str) -> str:
    return f"CASE WHEN len({parts}) >= 1 THEN {title_case(f'{parts}[1]')} END"


def last_name_of(parts: str) -> str:
    return (f"CASE WHEN len({parts}) >= 2 THEN array_to_string(list_transform({parts}[2:], "
            f"lambda p: {title_case('p')}), ' ') END")


def normalize_phone(e: str) -> str:
    digits = f"regexp_replace({e}, '[^\\p{{Nd}}+]', '', 'g')"
    n = f"length(regexp_replace({digits}, '[^\\p{{Nd}}]', '', 'g'))"
    d1 = f"(CASE WHEN starts_with({digits}, '00') THEN '+' || substr({digits}, 3) ELSE {digits} END)"
    d2 = (f"(CASE WHEN starts_with({d1}, '39') THEN '+39' || substr({d1}, 3) "
          f"WHEN regexp_full_match({d1}, '3\\p{{Nd}}{{8,9}}') THEN '+39' || {d1} ELSE {d1} END)")
    return f"CASE WHEN {n} >= 7 THEN {d2} END"


def phone_label_score(e: str) -> str:
    low = f"lower({e})"
    parts = ", ".join(f"CASE WHEN contains({low}, {q(h)}) THEN {s} ELSE 0 END" for h, s in L.PHONE_LABEL_SCORES.items())
    return f"greatest(0, {parts})"


def fax_only(e: str) -> str:
    low = f"lower({e})"
    keep = " OR ".join(f"contains({low}, {q(h)})" for h in L.FAX_OVERRIDE_HINTS)
    return f"(contains({low}, 'fax') AND NOT ({keep}))"


def clean_company(e: str) -> str:
    c = f"regexp_replace({norm_ws(e)}, '^[-•|.,;: ]+|[-•|.,;: ]+$', '', 'g')"
    low = f"lower({c})"
    words = f"list_filter(string_split({low}, ' '), lambda w: w <> '')"
    all_cased = f"(len(list_filter({words}, lambda w: NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lu}}\\p{{Lt}}]'))) = 0)"
    has_upper = f"regexp_matches({c}, '\\p{{Lu}}')"
    ok = (f"(length({c}) >= 3 AND NOT list_contains({lit_list(L.COMPANY_NOISE_TERMS)}, {low}) "
          f"AND (NOT {all_cased} OR {has_upper}))")
    return f"CASE WHEN {e} IS NOT NULL AND {ok} THEN {c} END"


def _contains_any(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


def org_from_line(e: str) -> str:
    s = strip(e)
    low = f"lower({s})"
    cb = f"lower(split_part({s}, ':', 1))"
    ca = strip(f"substr({s}, instr({s}, ':') + 1)")
    db = f"lower({strip(f'split_part({s}, {q(chr(45))}, 1)')})"
    da = strip(f"substr({s}, instr({s}, '-') + 1)")
    unl = f"regexp_replace(regexp_replace({s}, {q(ORG_LABEL_PREFIX_RE2)}, ''), '^[ -]+|[ -]+$', '', 'g')"
    return (f"CASE WHEN {s} = '' THEN NULL "
            f"WHEN contains({s}, ':') AND {_contains_any(cb, L.ORG_HINTS)} AND {ca} <> '' THEN {ca} "
            f"WHEN contains({s}, '-') AND {_contains_any(db, L.ORG_HINTS)} AND {da} <> '' THEN {da} "
            f"WHEN regexp_matches({low}, {q(LEGAL_FORM_RE2)}) AND {unl} <> '' THEN {unl} "
            f"WHEN {_contains_any(low, L.ORG_HINTS)} AND length({unl}) > 3 THEN {unl} END")


def org_from_lines(e: str) -> str:
    return f"list_filter(list_transform({split_lines(co(e))}, lambda l: {org_from_line('l')}), lambda x: x IS NOT NULL)[1]"


def company_phrase_cte(src: str = "messages", text: str = "body") -> str:
    """CTE ``cp(seq, company, name)`` over ``src``."""
    cols = []
    for k, (pat, gn, gc) in enumerate(COMPANY_PATTERNS_RE2, 1):
        cols.append(f"regexp_extract({text}, {q(pat)}, {gc}) AS craw{k}")
        cols.append(f"regexp_extract({text}, {q(pat)}, {gn}) AS nraw{k}" if gn else f"'' AS nraw{k}")
    stage1 = f"cp1 AS (SELECT seq, {', '.join(cols)} FROM {src})"
    c2 = []
    for k in range(1, 6):
        c2.append(f"{clean_company(f'nullif(craw{k}, {EMPTY})')} AS clean{k}")
        c2.append(f"(craw{k} <> '' AND len({name_parts(f'nraw{k}')}) > 0) AS nok{k}")
        c2.append(f"nraw{k}")
    stage2 = f"cp2 AS (SELECT seq, {', '.join(c2)} FROM cp1)"
    win = "CASE " + " ".join(f"WHEN clean{k} IS NOT NULL THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
    name = "CASE " + " ".join(f"WHEN nok{k} AND {k} <= w THEN nraw{k}" for k in range(1, 4)) + " END"
    stage3 = (f"cp AS (SELECT seq, coalesce(clean1, clean2, clean3, clean4, clean5) AS company, {name} AS name "
              f"FROM (SELECT *, {win} AS w FROM cp2))")
    return ",\n".join([stage1, stage2, stage3])


def phone_ctes(src: str = "messages", text: str = "body") -> str:
    """CTEs ``pl`` (lines), ``pc`` (candidates) and ``bp(seq, phone)`` over ``src``."""
    lines = split_lines(f"coalesce({text}, '')")
    return f"""
pl AS (
  SELECT seq, x.line AS line, x.li AS li FROM (
    SELECT seq, unnest(list_transform({lines}, lambda l, i: {{'line': l, 'li': i - 1}})) AS x FROM {src})),
pc AS (
  SELECT seq, li, y.pos AS pos, score, y.raw AS raw, {normalize_phone('y.raw')} AS number FROM (
    SELECT seq, li, {phone_label_score('line')} AS score,
           unnest(list_transform(regexp_extract_all(line, {q(P.PHONE)}), lambda r, j: {{'raw': r, 'pos': j - 1}})) AS y
    FROM pl WHERE NOT {fax_only('line')})),
pfirst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, number ORDER BY li, pos) AS rn
                 FROM pc WHERE number IS NOT NULL) WHERE rn = 1),
pbest AS (
  SELECT seq, number FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, li, pos) AS rank_in_msg
                           FROM pfirst) WHERE rank_in_msg = 1),
bp AS (
  SELECT s.seq, coalesce(b.number, list_filter(list_transform(regexp_extract_all(coalesce(s.{text}, ''), {q(P.PHONE)}),
         lambda r: {normalize_phone('r')}), lambda x: x IS NOT NULL)[1]) AS phone
  FROM {src} s LEFT JOIN pbest b ON s.seq = b.seq)"""


# ---------------------------------------------------------------------------
# classifier (tokens, features, naive Bayes, split, evaluation)
# ---------------------------------------------------------------------------

def ml_tokens(e: str, legacy_train: bool = False) -> str:
    stop = lit_list(L.ml_stopwords(legacy_train))
    return (f"list_filter(regexp_extract_all(lower(coalesce({e}, '')), {q(P.ML_TOKEN)}), "
            f"lambda x: length(x) > 2 AND NOT list_contains({stop}, x))")


def bigrams(t: str) -> str:
    """``t`` must be a column name."""
    return (f"CASE WHEN len({t}) >= 2 THEN list_transform({t}[1:len({t}) - 1], lambda x, i: x || ' ' || {t}[i + 1]) "
            f"ELSE []::varchar[] END")


def _count_in(low: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({low}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def feature_cols(x: str = "text") -> str:
    """Six feature columns for a text column ``x`` (serving definition)."""
    low = f"lower({x})"
    wc = f"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(string_split_regex({strip(x)}, {q(P.WS + '+')})) END)"
    qn = f"(length({x}) - length(replace({x}, '?', '')))"
    last5 = f"string_split({x}, chr(10))[greatest(len(string_split({x}, chr(10))) - 4, 1):len(string_split({x}, chr(10)))]"
    nonblank = f"list_filter({last5}, lambda l: {strip('l')} <> '')"
    window = f"(CASE WHEN len({nonblank}) > 0 THEN {nonblank} ELSE {last5} END)"
    ind = _count_in("lower(l)", L.SIGNATURE_INDICATORS)
    return ", ".join([
        f"least(CAST({_count_in(low, L.URGENCY_WORDS)} AS DOUBLE) / 3.0, 1.0) AS urgency_score",
        f"CASE WHEN {_count_in(low, L.GREETING_WORDS)} > 0 THEN 1.0 ELSE 0.0 END AS has_greeting",
        f"least(CAST({qn} AS DOUBLE) / greatest(CAST({wc} AS DOUBLE) / 50.0, 1.0), 1.0) AS question_density",
        f"least(CAST({wc} AS DOUBLE) / 200.0, 1.0) AS length_score",
        f"CASE WHEN regexp_matches({x}, {q(P.FEATURE_PHONE)}) OR regexp_matches({x}, {q(P.EMAIL)}) THEN 1.0 ELSE 0.0 END AS has_contact_info",
        f"CAST(len(list_filter({window}, lambda l: {ind} > 0)) AS DOUBLE) / greatest(len({window}), 1) AS signature_score",
    ])


def nb_ctes(train_src: str, score_src: str, p: str = "nb") -> str:
    """CTEs for a model trained on ``train_src(label, text)`` scoring ``score_src(id, text)``.

    Exposes ``{p}_terms(kind, term, n_pos, n_neg)``, ``{p}_st``, ``{p}_w`` and ``{p}_sc(id, score)``.
    """
    feats = L.FEATURE_NAMES
    wcols = ", ".join(
        f"2.0 * (coalesce(sum({f}) FILTER (WHERE label = 1), 0) / greatest(count(*) FILTER (WHERE label = 1), 1)"
        f" - coalesce(sum({f}) FILTER (WHERE label = 0), 0) / greatest(count(*) FILTER (WHERE label = 0), 1)) AS w_{f}"
        for f in feats)
    shift = " + ".join(f"s.{f} * w.w_{f}" for f in feats)
    return f"""
{p}_tt AS (SELECT label, {ml_tokens('text')} AS t FROM {train_src}),
{p}_tb AS (SELECT label, t, {bigrams('t')} AS b FROM {p}_tt),
{p}_terms AS (
  SELECT 'uni' AS kind, term, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg
  FROM (SELECT label, unnest(t) AS term FROM {p}_tb) GROUP BY term
  UNION ALL
  SELECT 'bi' AS kind, term, count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)
  FROM (SELECT label, unnest(b) AS term FROM {p}_tb) GROUP BY term),
{p}_st AS (
  SELECT d.prior_pos, d.prior_neg, u.total_pos, u.total_neg, greatest(u.v, 1) AS v FROM
    (SELECT CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / greatest(count(*), 1) AS prior_pos,
            CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) / greatest(count(*), 1) AS prior_neg FROM {train_src}) d,
    (SELECT coalesce(sum(n_pos), 0) AS total_pos, coalesce(sum(n_neg), 0) AS total_neg, count(*) AS v
     FROM {p}_terms WHERE kind = 'uni') u),
{p}_f AS (SELECT label, {feature_cols('text')} FROM {train_src}),
{p}_w AS (SELECT {wcols} FROM {p}_f),
{p}_sd AS (SELECT id, {ml_tokens('text')} AS t, {feature_cols('text')} FROM {score_src}),
{p}_sb AS (SELECT id, t, {bigrams('t')} AS b FROM {p}_sd),
{p}_lu AS (
  SELECT x.id, sum(ln((coalesce(m.n_pos, 0) + 1) / (st.total_pos + st.v))) AS lp,
               sum(ln((coalesce(m.n_neg, 0) + 1) / (st.total_neg + st.v))) AS ln
  FROM (SELECT id, unnest(t) AS term FROM {p}_sb) x
  LEFT JOIN {p}_terms m ON m.kind = 'uni' AND m.term = x.term CROSS JOIN {p}_st st GROUP BY x.id),
{p}_lb AS (
  SELECT x.id, sum(0.5 * ln((coalesce(m.n_pos, 0) + 1) / (st.total_pos + st.v))) AS lp,
               sum(0.5 * ln((coalesce(m.n_neg, 0) + 1) / (st.total_neg + st.v))) AS ln
  FROM (SELECT id, unnest(b) AS term FROM {p}_sb) x
  LEFT JOIN {p}_terms m ON m.kind = 'bi' AND m.term = x.term CROSS JOIN {p}_st st GROUP BY x.id),
{p}_lg AS (
  SELECT s.id, len(s.t) AS n,
         ln(st.prior_pos) + coalesce(u.lp, 0) + coalesce(b.lp, 0) + ({shift}) AS log_pos,
         ln(st.prior_neg) + coalesce(u.ln, 0) + coalesce(b.ln, 0) - 0.5 * ({shift}) AS log_neg
  FROM {p}_sd s LEFT JOIN {p}_lu u ON s.id = u.id LEFT JOIN {p}_lb b ON s.id = b.id
  CROSS JOIN {p}_st st CROSS JOIN {p}_w w),
{p}_sc AS (
  SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE
    exp(log_pos - greatest(log_pos, log_neg)) / (exp(log_pos - greatest(log_pos, log_neg)) + exp(log_neg - greatest(log_pos, log_neg)))
    END AS score FROM {p}_lg)"""


LABELLED_CTE = f"lm AS (SELECT seq AS id, label, subject, body, {combine_text('subject', 'body')} AS text FROM m WHERE label IS NOT NULL)"
MSG_TEXT_CTE = f"mt AS (SELECT seq AS id, {combine_text('subject', 'body')} AS text FROM messages)"


def split_cte(test_size: float, seed: int) -> str:
    return f"""sp0 AS (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS varchar) || ':{seed}'), id) AS split_rank,
         count(*) OVER (PARTITION BY label) AS n FROM lm),
sp AS (
  SELECT id, label, split_rank,
         split_rank <= greatest(1, floor(CAST(n AS DOUBLE) * (CAST(1.0 AS DOUBLE) - CAST({test_size} AS DOUBLE)))) AS is_train,
         split_rank > greatest(1, floor(CAST(n AS DOUBLE) * (CAST(1.0 AS DOUBLE) - CAST({test_size} AS DOUBLE))))
           OR (greatest(1, floor(CAST(n AS DOUBLE) * (CAST(1.0 AS DOUBLE) - CAST({test_size} AS DOUBLE)))) >= n AND split_rank = n) AS is_test
  FROM sp0),
trn AS (SELECT lm.* FROM lm JOIN sp USING (id) WHERE sp.is_train),
tst AS (SELECT lm.* FROM lm JOIN sp USING (id) WHERE sp.is_test)"""


def split_scored_ctes(test_size: float, seed: int) -> list[str]:
    return [LABELLED_CTE, split_cte(test_size, seed), nb_ctes("trn", "tst", "sn"),
            "scored AS (SELECT t.id, t.label, s.score FROM tst t JOIN sn_sc s ON t.id = s.id)"]


def curve_ctes(threshold: float = 0.5) -> str:
    return """cg AS (SELECT score, count(*) FILTER (WHERE label = 1) AS tp_g, count(*) FILTER (WHERE label <> 1) AS fp_g
               FROM scored GROUP BY score),
cc AS (SELECT score, tp_g, fp_g, sum(tp_g) OVER (ORDER BY score DESC) AS ctp, sum(fp_g) OVER (ORDER BY score DESC) AS cfp,
              row_number() OVER (ORDER BY score DESC) AS point FROM cg),
ctot AS (SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored),
roc AS (SELECT CAST(point AS BIGINT) AS point, score AS threshold, CAST(cfp AS DOUBLE) / neg AS fpr, CAST(ctp AS DOUBLE) / pos AS tpr
        FROM cc, ctot
        UNION ALL SELECT CAST(0 AS BIGINT), max(score) + 1, 0.0, 0.0 FROM cg),
auc AS (SELECT coalesce(sum((fpr - pf) * (tpr + pt) / 2.0), 0.0) AS roc_auc FROM (
          SELECT fpr, tpr, lag(fpr) OVER (ORDER BY point) AS pf, lag(tpr) OVER (ORDER BY point) AS pt FROM roc)
        WHERE pf IS NOT NULL),
conf AS (SELECT count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp,
                count(*) FILTER (WHERE score < {t} AND label = 0) AS tn, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn
         FROM scored),
met AS (SELECT tp, fp, tn, fn,
          CAST(tp + tn AS DOUBLE) / greatest(tp + fp + tn + fn, 1) AS accuracy,
          CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM conf),
met2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
                accuracy > 0.95 AS overfit FROM met)""".replace("{t}", str(threshold))


# ---------------------------------------------------------------------------
# ensemble
# ---------------------------------------------------------------------------

def ens_ctes() -> list[str]:
    return [LABELLED_CTE, MSG_TEXT_CTE, nb_ctes("lm", "mt"),
            f"er AS (SELECT s.id AS seq, s.score AS ml, {rule_score()} AS rule FROM nb_sc s JOIN messages m ON s.id = m.seq)",
            """ee AS (SELECT seq, ml, rule, least(rule / 2.0, 1.0) AS rn,
  CASE WHEN ml >= 0.9 OR ml <= 0.3 THEN ml ELSE 0.7 * ml + (1 - 0.7) * least(rule / 2.0, 1.0) END AS score,
  CASE WHEN ml >= 0.9 OR ml <= 0.3 THEN 'high' WHEN abs(ml - least(rule / 2.0, 1.0)) < 0.2 THEN 'high'
       WHEN abs(ml - least(rule / 2.0, 1.0)) < 0.4 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN ml >= 0.9 THEN 'ml_high_confidence' WHEN ml <= 0.3 THEN 'ml_low_confidence' ELSE 'weighted_ensemble' END AS method,
  CASE WHEN ml >= 0.9 OR ml <= 0.3 THEN NULL ELSE least(rule / 2.0, 1.0) END AS rule_normalized,
  CASE WHEN ml >= 0.9 OR ml <= 0.3 THEN NULL ELSE abs(ml - least(rule / 2.0, 1.0)) END AS agreement
  FROM er)""",
            """ed AS (SELECT *, CASE WHEN confidence = 'high' THEN 0.5 WHEN confidence = 'medium' THEN 0.5 + 0.1
                      ELSE 0.5 + 0.15 END AS applied FROM ee)"""]


def parse_ctes() -> list[str]:
    """CTEs ending in ``pcf(seq, first_name, last_name, email, phone, org)`` over ``messages``."""
    hn = name_parts(f"CASE WHEN {header_email()} IS NOT NULL THEN {display_name('from_header')} END")
    return [company_phrase_cte(), phone_ctes(), f"""
pcx AS (
  SELECT m.seq, {hn} AS hp, {name_parts('cp.name')} AS pp,
         coalesce({header_email()}, {body_email('m.body')}) AS email,
         bp.phone AS phone, coalesce(cp.company, {org_from_lines('m.body')}) AS org
  FROM messages m JOIN cp ON m.seq = cp.seq JOIN bp ON m.seq = bp.seq)""", f"""
pcf AS (
  SELECT seq,
    coalesce({first_name_of('hp')}, {first_name_of('pp')}) AS first_name,
    CASE WHEN len(hp) >= 1 THEN {last_name_of('hp')} ELSE {last_name_of('pp')} END AS last_name,
    email, phone, org
  FROM pcx)"""]


def pipeline_ctes(run1_before: str, run1_ts: str, run2_ts: str, domains) -> list[str]:
    """Two ingestion runs stated in SQL; exposes pmf, led1, r2s, kept2, o2, c1, c2, leads1, leads2."""
    allowed, reason = sender_check("from_header", domains)
    first_nonempty = lambda f: f"arg_min({f}, seq) FILTER (WHERE {f} IS NOT NULL AND {f} <> '')"
    agg_cols = ", ".join([
        "min(seq) AS first_seq",
        *[f"{first_nonempty(f)} AS {f}" for f in ("first_name", "last_name", "phone", "org")],
        "arg_max(subject_h, seq) FILTER (WHERE subject_h IS NOT NULL AND subject_h <> '') AS last_subject",
        "arg_max(received_at, seq) FILTER (WHERE received_at IS NOT NULL) AS last_received",
        "arg_max(excerpt, seq) AS last_excerpt",
    ])

    def dedup(src: str, name: str) -> str:
        return f"""{name}_a AS (SELECT seq, mid, uid FROM (SELECT *, min(seq) OVER (PARTITION BY mid) AS f FROM {src})
                 WHERE mid IS NULL OR seq = f),
{name} AS (SELECT seq, mid, uid FROM (SELECT *, min(seq) OVER (PARTITION BY uid) AS f FROM {name}_a)
           WHERE uid IS NULL OR seq = f)"""

    def outcome(kept: str) -> str:
        return (f"CASE WHEN seq NOT IN (SELECT seq FROM {kept}) THEN 'duplicate' WHEN NOT allowed THEN 'not_allowed' "
                f"WHEN NOT is_lead THEN 'not_lead' WHEN email IS NULL THEN 'missing_email' ELSE 'processed' END")

    return parse_ctes() + [f"""
pmf AS (
  SELECT m.seq, m.folder, nullif({strip('m.message_id')}, '') AS mid, m.imap_uid AS uid, m.received_date,
         m.from_header, {sender_domain('m.from_header')} AS from_domain,
         {allowed.replace('from_header', 'm.from_header')} AS allowed,
         {reason.replace('from_header', 'm.from_header')} AS allow_reason,
         {rule_score(subject='m.subject', body='m.body', others=other_headers('m.message_id', 'm.from_header', 'm.date_header'))} AS rule,
         p.email, p.first_name, p.last_name, p.phone, p.org, nullif(m.subject, '') AS subject_h,
         {received_at_str('m.date_header')} AS received_at,
         {received_iso_local('m.date_header')} AS received_iso,
         {excerpt('m.body')} AS excerpt
  FROM messages m JOIN pcf p ON m.seq = p.seq)""", """
pm AS (SELECT *, rule >= 2.0 AS is_lead FROM pmf)""",
        f"r1m AS (SELECT seq, mid, uid FROM pm WHERE received_date < DATE '{run1_before}')",
        dedup("r1m", "kept1"), f"""
o1 AS (SELECT pm.*, {outcome('kept1')} AS outcome FROM pm WHERE received_date < DATE '{run1_before}')""", """
led1 AS (SELECT coalesce(mid, 'uid:' || uid, CASE WHEN outcome = 'processed' THEN sha256(email) END) AS message_id,
                uid AS imap_uid FROM o1 WHERE outcome <> 'duplicate')""", """
r2s AS (SELECT seq, mid, uid FROM pm
        WHERE NOT coalesce(mid IN (SELECT message_id FROM led1), false)
          AND NOT coalesce(uid IN (SELECT imap_uid FROM led1 WHERE imap_uid IS NOT NULL), false))""",
        dedup("r2s", "kept2"), f"""
o2a AS (SELECT pm.*, {outcome('kept2')} AS outcome FROM pm)""", f"""
a1 AS (SELECT email, {agg_cols} FROM o1 WHERE outcome = 'processed' GROUP BY email)""", f"""
c1 AS (SELECT sha256(email) AS id, email, first_name, last_name, phone, org, 'email' AS source, false AS consent,
              '{run1_ts}' AS created_at, last_subject AS last_message_subject, last_received AS last_message_received_at,
              last_excerpt AS last_message_excerpt FROM a1)""", """
leads1 AS (SELECT o1.* FROM o1 JOIN a1 ON o1.email = a1.email AND o1.seq = a1.first_seq WHERE o1.outcome = 'processed')""", f"""
a2 AS (SELECT email, {agg_cols} FROM o2a WHERE outcome = 'processed' GROUP BY email)""", f"""
c2 AS (
  SELECT coalesce(c.id, sha256(coalesce(c.email, a.email))) AS id, coalesce(c.email, a.email) AS email,
    CASE WHEN c.first_name <> '' THEN c.first_name ELSE a.first_name END AS first_name,
    CASE WHEN c.last_name <> '' THEN c.last_name ELSE a.last_name END AS last_name,
    CASE WHEN c.phone <> '' THEN c.phone ELSE a.phone END AS phone,
    CASE WHEN c.org <> '' THEN c.org ELSE a.org END AS org,
    coalesce(c.source, 'email') AS source, coalesce(c.consent, false) AS consent,
    coalesce(c.created_at, '{run2_ts}') AS created_at,
    coalesce(a.last_subject, c.last_message_subject) AS last_message_subject,
    coalesce(a.last_received, c.last_message_received_at) AS last_message_received_at,
    CASE WHEN a.email IS NOT NULL THEN a.last_excerpt ELSE c.last_message_excerpt END AS last_message_excerpt
  FROM c1 c FULL OUTER JOIN a2 a ON c.email = a.email)""", """
o2 AS (SELECT o2a.*, (o2a.outcome = 'processed' AND a2.email IS NOT NULL AND o2a.email NOT IN (SELECT email FROM c1)) AS created
       FROM o2a LEFT JOIN a2 ON o2a.email = a2.email AND o2a.seq = a2.first_seq)""", """
leads2 AS (SELECT * FROM o2 WHERE created)"""]


def iso(ts: str) -> str:
    """'YYYY-MM-DD HH:MM:SS' text to 'YYYY-MM-DDTHH:MM:SS'."""
    return f"replace({ts}, ' ', 'T')"


def augment_word(word: str) -> str:
    return f"(?i)(^|[^{_W}]){word}([^{_W}]|$)"


def augment_sql() -> str:
    parts = []
    for k, (word, repl) in enumerate(L.AUGMENT_SYNONYMS.items(), 1):
        pat = q(augment_word(word))
        rep = q("\\1" + repl[0] + "\\2")
        ns = f"regexp_replace(regexp_replace(coalesce(subject, ''), {pat}, {rep}, 'g'), {pat}, {rep}, 'g')"
        nbd = f"regexp_replace(regexp_replace(coalesce(body, ''), {pat}, {rep}, 'g'), {pat}, {rep}, 'g')"
        trig = f"(contains(lower(coalesce(subject, '')), {q(word)}) OR contains(lower(coalesce(body, '')), {q(word)}))"
        parts.append(f"CASE WHEN label = 1 AND {trig} AND ({ns} <> coalesce(subject, '') OR {nbd} <> coalesce(body, '')) "
                     f"THEN {{'label': label, 'subject': {ns}, 'body': {nbd}}} END")
    arr = "list_filter([{'label': label, 'subject': subject, 'body': body}, " + ", ".join(parts) + "], lambda v: v IS NOT NULL)[1:3]"
    return f"""
SELECT id, CAST(x.i - 1 AS INT) AS variant, x.v.label AS label, x.v.subject AS subject, x.v.body AS body FROM (
  SELECT id, unnest(list_transform({arr}, lambda v, i: {{'v': v, 'i': i}})) AS x FROM lm)"""
