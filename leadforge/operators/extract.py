"""Contact field extraction (E1-E10) as per-row Column expressions.

Everything is evaluated inside the row: candidate lists are arrays of structs
that are sorted and filtered in place, so extraction never shuffles and its
cost grows linearly with the text. Regexes spell ``\\w``/``\\s``/``\\d`` as
explicit Unicode classes and word boundaries as look-arounds, which keeps the
Java engine on the same semantics as Python's ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import let
from ..functions.patterns import DIGIT, EMAIL, HAS_FEATURE_PHONE, PHONE, WORD_CHARS, WS, WS_CHARS
from .text import _c, address_of, display_name_of, normalize_whitespace, split_lines, strip_ws

NB = f"(?<![{WORD_CHARS}])"  # word boundary before
NA = f"(?![{WORD_CHARS}])"   # word boundary after
_NAME = rf"([{WORD_CHARS}'’{WS_CHARS}.]{{2,60}}?)"
_COMPANY = rf"([{WORD_CHARS}&'’.,\-{WS_CHARS}]{{3,}})"
_S = f"[{WS_CHARS}]+"

# FIXED VALUES (patterns) — self-introduction phrases, tried in this order.
# (regex, group of the name or 0, group of the company)
COMPANY_PATTERNS = [
    (rf"(?i){NB}sono{_S}{_NAME}{_S}(?:di|del|della|dell'|dello){_S}{_COMPANY}", 1, 2),
    (rf"(?i){NB}sono{_S}{_NAME}{_S}e{_S}lavoro{_S}(?:per|presso|in){_S}{_COMPANY}", 1, 2),
    (rf"(?i){NB}mi{_S}chiamo{_S}{_NAME}{_S}e{_S}(?:sono|lavoro){_S}(?:per|presso|in|di|del|della|dell'|dello){_S}{_COMPANY}", 1, 2),
    (rf"(?i){NB}lavoro{_S}(?:per|presso|in){_S}{_COMPANY}", 0, 1),
    (rf"(?iu){NB}(?:azienda|società|societa|company){_S}(?:si{_S}chiama|chiamata|denominata){_S}{_COMPANY}", 0, 1),
]
# Words each phrase cannot match without (lower-cased text must contain one): a cheap
# substring gate in front of the regex scan, which leaves results unchanged.
PATTERN_GATES = [["sono"], ["sono"], ["chiamo"], ["lavoro"], ["chiama", "denominata"]]
# the words each phrase starts with: looked at before the word boundary, they dismiss nearly every place at once
PATTERN_STARTS = ["sono", "sono", "mi", "lavoro", "azienda|società|societa|company"]
# every number starts with one of these
PHONE_FROM_START = rf"(?=[+({DIGIT}]){PHONE}"

LEGAL_FORM = f"{NB}(?:{'|'.join(L.LEGAL_FORMS)}){NA}"
ORG_LABEL_PREFIX = rf"(?iu)^(?:{'|'.join(L.ORG_LABEL_WORDS)})[:\-{WS_CHARS}]*"


# ---------------------------------------------------------------------------
# header lookup, email and names
# ---------------------------------------------------------------------------

def header_value(headers, name: str) -> Column:
    """First non-empty value whose key equals ``name`` case-insensitively."""
    hit = F.filter(
        F.map_entries(_c(headers)),
        lambda e: (F.lower(e["key"]) == name.lower()) & e["value"].isNotNull() & (e["value"] != ""),
    )
    return F.try_element_at(hit, F.lit(1))["value"]


def _first_address(value: Column) -> Column:
    """Address of the first entry of an address-list header ('' when none)."""
    return address_of(F.coalesce(value, F.lit("")))


def name_parts(full_name) -> Column:
    """E2 helper: lower-cased words of a name with courtesy titles removed."""
    words = F.split(F.lower(normalize_whitespace(F.coalesce(_c(full_name), F.lit("")))), " ")
    return F.filter(
        words, lambda w: (w != "") & ~F.regexp_replace(w, r"\.+$", "").isin(L.NAME_TITLES)
    )


def title_case(word) -> Column:
    """Python ``str.title()`` for one word: each run of letters capitalised."""
    runs = F.regexp_extract_all(_c(word), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))),
        "",
    )


def split_name(full_name) -> Column:
    """struct(first_name, last_name) — first word / remaining words, title-cased."""
    def build(p):
        first = F.when(F.size(p) >= 1, title_case(p[0]))
        last = F.when(F.size(p) >= 2, F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), title_case), " "))
        return F.struct(first.alias("first_name"), last.alias("last_name"))
    return let(name_parts(full_name), build)


def header_contact(headers) -> Column:
    """E1 (headers part): struct(email, name, overwrite) from Reply-To, else From."""
    reply = header_value(headers, "reply-to")
    frm = header_value(headers, "from")
    r_addr, f_addr = _first_address(reply), _first_address(frm)
    use_reply = r_addr != ""
    src = F.when(use_reply, reply).otherwise(frm)
    email = F.when(use_reply, r_addr).when(f_addr != "", f_addr)
    name = F.when(email.isNotNull(), display_name_of(src))
    return F.struct(email.alias("email"), name.alias("name"), use_reply.alias("overwrite"))


def exact_header_contact(headers) -> Column:
    """E1, exact mode: the first (name, address) pair via the standard library's
    RFC-5322 address-list parser, run as a vectorised pandas UDF. Use it when
    headers carry quoted names, comments or commas inside names."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<email:string,name:string,overwrite:boolean>")
    def first_pair(reply, frm):
        import pandas as pd
        from email.utils import getaddresses

        def pick(value):
            if not isinstance(value, str) or not value:
                return None
            for name, addr in getaddresses([value]):
                if addr:
                    return name, addr.strip()
            return None

        rows = []
        for r, f in zip(reply, frm):
            hit, over = pick(r), True
            if hit is None:
                hit, over = pick(f), False
            rows.append({"email": hit[1] if hit else None, "name": hit[0] if hit else None,
                         "overwrite": bool(hit) and over})
        return pd.DataFrame(rows, columns=["email", "name", "overwrite"])

    return first_pair(header_value(headers, "reply-to"), header_value(headers, "from"))


def body_email(text) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(text), F.lit("")), EMAIL, 0), F.lit(""))


# ---------------------------------------------------------------------------
# phones (E3-E6)
# ---------------------------------------------------------------------------

def normalize_phone(raw) -> Column:
    """Keep digits and '+', need 7 digits, 00 -> +, 39... -> +39..., 3 + 8-9 digits -> +39."""
    def build(digits):
        n_digits = F.char_length(F.regexp_replace(digits, f"[^{DIGIT}]", ""))
        d = F.when(digits.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 1 << 30))).otherwise(digits)
        d = (
            F.when(d.startswith("39"), F.concat(F.lit("+39"), F.substring(d, 3, 1 << 30)))
            .when(d.rlike(f"^3{DIGIT}{{8,9}}$"), F.concat(F.lit("+39"), d))
            .otherwise(d)
        )
        return F.when(n_digits >= 7, d)
    return let(F.regexp_replace(_c(raw), f"[^{DIGIT}+]", ""), build)


def phone_label_score(line) -> Column:
    """E5: best label hint on the line (cell/mobile 5, tel/phone 3, office/work 2, fax 0)."""
    low = F.lower(_c(line))
    return F.greatest(F.lit(0), *[F.when(low.contains(h), F.lit(s)).otherwise(F.lit(0))
                                  for h, s in L.PHONE_LABEL_SCORES.items()])


def fax_only(line) -> Column:
    """A fax line is skipped unless it also names a cell, mobile or tel number."""
    low = F.lower(_c(line))
    keep = None
    for h in L.FAX_OVERRIDE_HINTS:
        keep = low.contains(h) if keep is None else (keep | low.contains(h))
    return low.contains("fax") & ~keep


def phone_candidates(text) -> Column:
    """E3 + E5: array<struct(line, pos, score, raw, number)> over non-fax lines."""
    lines = split_lines(F.coalesce(_c(text), F.lit("")))

    empty = F.array().cast("array<struct<line:int,pos:int,score:int,raw:string,number:string>>")

    def per_line(line, i):
        def scored(found):
            # label hints are only looked at on lines that hold a number
            def build(low):
                score = phone_label_score(low)
                return F.when(fax_only(low), empty).otherwise(F.transform(found, lambda raw, j: F.struct(
                    i.alias("line"), j.alias("pos"), score.alias("score"), raw.alias("raw"),
                    normalize_phone(raw).alias("number"))))
            return F.when(F.size(found) == 0, empty).otherwise(let(F.lower(line), build))
        return let(F.regexp_extract_all(line, F.lit(PHONE_FROM_START), 0), scored)

    return F.flatten(F.transform(lines, per_line))


def best_phone(text) -> Column:
    """Highest score, then earliest line/position, among first occurrences of each number.

    Falls back to the first valid number anywhere in the text (matches may then
    span lines) when no line yields a candidate. A text without a digit and seven
    more characters of a number holds none, on its lines or across them.
    """
    def pick(cands):
        valid = F.filter(cands, lambda c: c["number"].isNotNull())
        by_number = F.array_sort(F.transform(valid, lambda c: F.struct(
            c["number"].alias("number"), c["line"].alias("line"), c["pos"].alias("pos"), c["score"].alias("score"))))
        firsts = F.filter(by_number, lambda c, k: F.when(k == 0, F.lit(True)).otherwise(
            c["number"] != F.element_at(by_number, k)["number"]))
        ranked = F.array_min(F.transform(firsts, lambda c: F.struct(
            (-c["score"]).alias("neg_score"), c["line"].alias("line"), c["pos"].alias("pos"),
            c["number"].alias("number"))))
        return ranked["number"]

    t = F.coalesce(_c(text), F.lit(""))
    fallback = F.try_element_at(
        F.filter(F.transform(F.regexp_extract_all(t, F.lit(PHONE_FROM_START), 0), normalize_phone), lambda x: x.isNotNull()),
        F.lit(1),
    )
    return F.when(t.rlike(HAS_FEATURE_PHONE), F.coalesce(let(phone_candidates(t), pick), fallback))


# ---------------------------------------------------------------------------
# company (E7-E9)
# ---------------------------------------------------------------------------

def clean_company(candidate) -> Column:
    """Trim punctuation, at least 3 chars, not a noise term, and must look like a name."""
    def build(c):
        low = F.lower(c)
        words = F.filter(F.split(low, " "), lambda w: w != "")
        all_cased = F.forall(words, lambda w: w.rlike(r"[\p{Ll}\p{Lu}\p{Lt}]"))
        has_upper = c.rlike(r"\p{Lu}")
        ok = (F.char_length(c) >= 3) & ~low.isin(L.COMPANY_NOISE_TERMS) & (~all_cased | has_upper)
        return F.when(ok, c)
    return let(F.regexp_replace(normalize_whitespace(_c(candidate)), r"^[-•|.,;: ]+|[-•|.,;: ]+$", ""), build)


def company_phrase(text) -> Column:
    """struct(company, name) from the ordered self-introduction phrases.

    Each phrase contributes its first match only; the first phrase with a clean
    company wins; the name comes from the first matching phrase (up to the
    winner) whose name survives title removal.
    """
    def phrase(pat, g_name, g_company):
        # the match alone gives the groups it gives in the text: a phrase looks at nothing behind its end
        def taken(m):
            name = F.regexp_extract(m, pat, g_name) if g_name else F.lit("")
            return F.when(m != "", F.struct(
                clean_company(F.regexp_extract(m, pat, g_company)).alias("company"),
                let(name, lambda n: F.when(F.size(name_parts(n)) > 0, n)).alias("name"))).otherwise(
                F.struct(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("name")))
        return taken

    def phrases(r):
        t, low = r["t"], r["low"]
        found = []
        for (pat, g_name, g_company), gate, start in zip(COMPANY_PATTERNS, PATTERN_GATES, PATTERN_STARTS):
            flags, rest = pat.split(")", 1)
            pat = f"{flags})(?={start}){rest}"
            match = F.when(_contains_any(low, gate), F.regexp_extract(t, pat, 0)).otherwise(F.lit(""))
            found.append(let(match, phrase(pat, g_name, g_company)))
        return F.array(*found)

    def decide(arr):
        upto = F.array_position(F.transform(arr, lambda x: x["company"].isNotNull()), True)
        window = F.when(upto > 0, F.slice(arr, 1, upto)).otherwise(arr)
        name = F.try_element_at(F.filter(F.transform(window, lambda x: x["name"]), lambda n: n.isNotNull()), F.lit(1))
        company = F.try_element_at(F.filter(F.transform(arr, lambda x: x["company"]), lambda n: n.isNotNull()), F.lit(1))
        return F.struct(company.alias("company"), name.alias("name"))

    t = F.coalesce(_c(text), F.lit(""))
    bound = F.struct(t.alias("t"), F.lower(t).alias("low"))
    return let(let(bound, phrases), decide)


def _contains_any(s: Column, words) -> Column:
    cond = None
    for w in words:
        c = s.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def org_from_line(line) -> Column:
    """Company named on one line (label:, label -, legal form, or any hint).

    Every rule needs an organisation hint somewhere on the line (the legal forms
    are hints too), so lines without one are dismissed after a single check.
    """
    def build(r):
        s, low = r["s"], r["low"]
        colon_before = F.lower(F.substring_index(s, ":", 1))
        colon_after = strip_ws(F.substring(s, F.instr(s, ":") + 1, 1 << 30))
        dash_before = F.lower(strip_ws(F.substring_index(s, "-", 1)))
        dash_after = strip_ws(F.substring(s, F.instr(s, "-") + 1, 1 << 30))
        unlabeled = F.regexp_replace(F.regexp_replace(s, ORG_LABEL_PREFIX, ""), r"^[ -]+|[ -]+$", "")
        return (
            F.when((s == "") | ~_contains_any(low, L.ORG_HINTS), F.lit(None))
            .when(s.contains(":") & _contains_any(colon_before, L.ORG_HINTS) & (colon_after != ""), colon_after)
            .when(s.contains("-") & _contains_any(dash_before, L.ORG_HINTS) & (dash_after != ""), dash_after)
            .when(low.rlike(LEGAL_FORM) & (unlabeled != ""), unlabeled)
            .when(_contains_any(low, L.ORG_HINTS) & (F.char_length(unlabeled) > 3), unlabeled)
        )
    return let(strip_ws(_c(line)), lambda s: let(F.struct(s.alias("s"), F.lower(s).alias("low")), build))


def org_from_lines(text) -> Column:
    """The first line's company; a text without a hint is not split, lines behind the first company are not read."""
    def until_found(found, line):
        return F.when(found.isNotNull(), found).otherwise(org_from_line(line))

    t = F.coalesce(_c(text), F.lit(""))
    return F.when(_contains_any(F.lower(t), L.ORG_HINTS),
                  F.aggregate(split_lines(t), F.lit(None).cast("string"), until_found))


# ---------------------------------------------------------------------------
# composite
# ---------------------------------------------------------------------------

def parse_contact(text, headers, exact_addresses: bool = False) -> Column:
    """struct(first_name, last_name, email, phone, org) for one message.

    ``exact_addresses`` reads Reply-To/From with the standard-library parser
    (pandas UDF) instead of the built-in ``Name <addr>`` expressions.
    """
    t = F.coalesce(_c(text), F.lit(""))
    hdr_contact = exact_header_contact(headers) if exact_addresses else header_contact(headers)

    def build(r):
        hdr, phrase = r["hdr"], r["phrase"]
        hname = split_name(hdr["name"])
        pname = split_name(phrase["name"])
        first = F.coalesce(hname["first_name"], pname["first_name"])
        # a phrase name is used only when the headers gave no first name
        last = F.when(hname["first_name"].isNotNull(), hname["last_name"]).otherwise(pname["last_name"])
        return F.struct(
            first.alias("first_name"),
            last.alias("last_name"),
            F.coalesce(hdr["email"], body_email(t)).alias("email"),
            best_phone(t).alias("phone"),
            F.coalesce(phrase["company"], org_from_lines(t)).alias("org"),
        )

    return let(F.struct(hdr_contact.alias("hdr"), company_phrase(t).alias("phrase")), build)
