"""Scalar projections over message text and headers (Column -> Column).

All of these are built-in expressions, so they stay inside whole-stage codegen
and need no shuffle: they scale with the number of rows and run wherever the
rows already are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import let
from ..functions.patterns import LINE_BREAK, WS, WS_SET


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(text) -> Column:
    """Collapse every whitespace run to one space and trim the ends."""
    return F.regexp_replace(F.regexp_replace(_c(text), f"{WS}+", " "), "^ | $", "")


def strip_ws(text) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace of any kind (native trim)."""
    return F.btrim(_c(text), F.lit(WS_SET))


def split_lines(text) -> Column:
    """Python ``str.splitlines()``: no trailing empty element after a final break."""
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(t, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    )


QUOTED = r'"(?:[^"\\]|\\.)*"'
COMMENT = r"\([^()]*\)"
ADDRESS = rf"^(?:{QUOTED}|[^\s,<>@\"]+)@[^\s,<>@]+$"


def first_entry(header) -> Column:
    """The first entry of an address-list header without quoted names, escapes, comments and a group's name.

    A quoted string right before an ``@`` is a local part and stays. Only headers that hold one of the signs in
    question are taken apart.
    """
    h = F.coalesce(_c(header), F.lit(""))

    def plain(x):
        bare = F.regexp_replace(x, rf"{QUOTED}(?!@)", "")
        bare = F.regexp_replace(bare, r'\\[^"]', " ")
        for _ in range(3):  # nested comments, from the inside
            bare = F.regexp_replace(bare, COMMENT, " ")
        bare = F.regexp_replace(bare, r'^[^"<>@,:;]*:', "")
        return F.regexp_extract(bare, rf"^[,;\s]*((?:{QUOTED}|[^,;])*)", 1)

    return F.when(h.rlike(r'["(,;:\\]'), plain(h)).otherwise(h)


def address_of(header) -> Column:
    """Address of the first entry of an RFC-822 address header (``Name <a@b>``, ``a@b (Name)``, ``a@b, c@d``, ``Team: a@b;``).

    A bracket that is not closed ends with the entry. What holds an ``@`` but is no address (nothing, a blank or a
    bracket before it, or two of them) gives an empty string; an entry without ``@`` is returned as it is.
    """
    def checked(a):
        return F.when(a.contains("@") & ~a.rlike(ADDRESS), F.lit("")).otherwise(a)
    return let(first_entry(header), lambda h: let(strip_ws(
        F.when(h.contains("<"), F.regexp_extract(h, r"<([^<>]*)", 1)).otherwise(h)), checked))


def display_name_of(header) -> Column:
    """Display name of the first entry: a quoted string, the words before ``<addr>``, or the comment behind a bare address.

    A quote without its partner is dropped.
    """
    h = F.coalesce(_c(header), F.lit(""))
    quoted = F.regexp_extract(h, rf"^\s*({QUOTED})\s*<[^<>]*>", 1)
    unquoted = F.regexp_replace(F.regexp_replace(quoted, '^"|"$', ""), r"\\(.)", "$1")
    before = strip_ws(F.regexp_replace(F.regexp_extract(first_entry(h), r"^([^<]*)<", 1), '"', ""))
    comment = strip_ws(F.regexp_extract(h, r"^[^<,(]*\(((?:[^()]|\([^()]*\))*)\)", 1))
    return (F.when(quoted != "", unquoted).when(first_entry(h).contains("<"), before)
            .otherwise(F.when(h.contains("("), comment).otherwise("")))


def sender_domain(from_header) -> Column:
    """Lower-cased domain after the last ``@`` of the From address; null without ``@``."""
    addr = F.lower(address_of(from_header))
    return F.when(addr.contains("@"), F.substring_index(addr, "@", -1))


def plain_text(body) -> Column:
    """Strip markup (only if both ``<`` and ``>`` occur), decode entities, collapse spaces.

    Script, style and comment content is dropped; every tag becomes a space;
    entities of marked-up text are decoded twice, as the parser and the later
    unescape step each decode once, others once.
    """
    b = _c(body)
    stripped = b
    for pat in [
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"</?[A-Za-z][^>]*>|<![^>]*>|<\?[^>]*>",
    ]:
        stripped = F.regexp_replace(stripped, pat, " ")
    text = F.when(b.contains("<") & b.contains(">"), stripped).otherwise(b)
    markup = b.contains("<") & b.contains(">")
    # only texts that hold an ampersand go through the decoder; markup is decoded once by its parser, once after it
    decoded = _unescape()(F.when(text.contains("&"), text), F.when(markup, 2).otherwise(1))
    return normalize_whitespace(F.regexp_replace(F.coalesce(decoded, text), "\u00a0", " "))


def _unescape():
    """All named and numeric character references, vectorised; null stays null."""
    @F.pandas_udf("string")
    def unescape(texts: pd.Series, times: pd.Series) -> pd.Series:
        from html import unescape as decode

        out = []
        for text, n in zip(texts, times):
            for _ in range(int(n) if text is not None else 0):
                text = decode(text)
            out.append(text)
        return pd.Series(out, dtype=object)

    return unescape


def excerpt(body, max_chars: int = L.BODY_EXCERPT_CHARS) -> Column:
    """One-line excerpt of the plain text; longer text is cut to max-1 chars + ellipsis."""
    return let(plain_text(body), lambda t: F.when(F.char_length(t) <= max_chars, t).otherwise(
        F.concat(F.substring(t, 1, max_chars - 1), F.lit("…"))
    ))


# FIXED VALUES — zone names of RFC 822 and their offsets
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
         "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATE = (r"(?i)^\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})[ -]+([a-z]{3,9})[ -]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
        r"(?:\s*([+-]\d{4})|\s+([a-z]{1,5}))?\s*(?:\([^)]*\)\s*)?$")


def _date_parts(date_header) -> Column:
    """struct(local timestamp text, offset) of an RFC-2822 date; null fields where it is none.

    Two-digit years up to 68 are 20xx; a missing or unknown zone counts as UTC. Times may have dots for colons, and
    the order of C's ``asctime`` (``Mon Jan  1 09:30:00 2024``) is read too; a month goes by its name or its first
    three letters.
    """
    d = F.regexp_replace(F.coalesce(_c(date_header), F.lit("")), ",(\\S)", ", $1")
    d = F.when(d.contains("."), F.regexp_replace(F.regexp_replace(
        d, r"(?<=\s)(\d{1,2})\.(\d{2})\.(\d{2})(?=\s|$)", "$1:$2:$3"), r"(?<=\s)(\d{1,2})\.(\d{2})(?=\s|$)", "$1:$2")).otherwise(d)
    d = F.when(d.rlike(r"[A-Za-z]\s+\d{1,2}\s+\d{1,2}:"), F.regexp_replace(
        d, r"(?i)^\s*(?:[a-z]+,?\s+)?([a-z]{3,9})\s+(\d{1,2})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s+(\d{4})\s*$", "$2 $1 $4 $3")).otherwise(d)

    def part(i):
        return F.regexp_extract(d, DATE, i)

    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(
        F.concat(F.when(part(3) <= "68", F.lit("20")).otherwise(F.lit("19")), part(3)))
    name = F.upper(part(8))
    named = F.lit("+0000")
    for zone, offset in ZONES.items():
        named = F.when(name == zone, F.lit(offset)).otherwise(named)
    offset = F.when(part(7) != "", part(7)).when(name == "", F.lit("+0000")).otherwise(named)
    month = F.lower(part(2))
    local = F.concat(part(1), F.lit(" "), F.initcap(F.substring(month, 1, 3)), F.lit(" "), year, F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"), part(5),
                     F.lit(":"), F.when(part(6) != "", part(6)).otherwise("00"))
    found = (part(1) != "") & month.isin([*MONTHS, *(m[:3] for m in MONTHS)])
    return F.struct(F.when(found, local).alias("local"), F.when(found, offset).alias("offset"))


def received_at(date_header) -> Column:
    """RFC-2822 ``Date`` value to a UTC timestamp; anything unparsable gives null."""
    return let(_date_parts(date_header), lambda p: F.try_to_timestamp(
        F.concat(p["local"], F.lit(" "), p["offset"]), F.lit("d MMM yyyy HH:mm:ss Z")))


def received_at_iso_local(date_header) -> Column:
    """``Date`` as ISO-8601 in the sender's own offset (``2024-01-01T09:30:00+01:00``), else null."""
    return let(_date_parts(date_header), lambda p: F.concat(
        F.date_format(F.try_to_timestamp(p["local"], F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"),
        F.substring(p["offset"], 1, 3), F.lit(":"), F.substring(p["offset"], 4, 2)))


def combine_text(subject, body) -> Column:
    """P5: subject and body, each trimmed, joined by a newline when both are non-empty."""
    parts = F.struct(F.coalesce(strip_ws(_c(subject)), F.lit("")).alias("s"),
                     F.coalesce(strip_ws(_c(body)), F.lit("")).alias("b"))
    return let(parts, lambda p: F.when((p["s"] != "") & (p["b"] != ""), F.concat(p["s"], F.lit("\n"), p["b"]))
               .otherwise(F.concat(p["s"], p["b"])))


def sanitize_folder(folder) -> Column:
    """Folder label, trimmed, ``unknown`` when empty."""
    f = F.coalesce(strip_ws(_c(folder)), F.lit(""))
    return F.when(f == "", F.lit("unknown")).otherwise(f)


def sanitize_domain(domain) -> Column:
    """Domain label, trimmed and lower-cased, ``unknown`` when empty."""
    d = F.coalesce(F.lower(strip_ws(_c(domain))), F.lit(""))
    return F.when(d == "", F.lit("unknown")).otherwise(d)


def email_domain(email) -> Column:
    """Domain of a stored contact email (trim, lower, after the last ``@``)."""
    e = F.lower(strip_ws(_c(email)))
    return F.when(e.contains("@"), F.substring_index(e, "@", -1))


def coerce_timestamp(value) -> Column:
    """P10: ISO-8601 text (with or without offset) to a naive UTC timestamp, else null."""
    return F.try_to_timestamp(_c(value))


def confidence_band(score) -> Column:
    """Probability to a confidence label."""
    s = _c(score)
    return (
        F.when(s >= 0.9, "high").when(s >= 0.7, "medium").when(s >= 0.5, "low").otherwise("very_low")
    )


def since_days_filter(received, as_of, days=None) -> Column:
    """S3: messages received on or after ``as_of - days`` (date granularity, inclusive).

    ``days`` below 1 or invalid falls back to the default window.
    """
    try:
        n = int(str(days).strip()) if days is not None else L.SINCE_DAYS_DEFAULT
    except ValueError:
        n = L.SINCE_DAYS_DEFAULT
    if n < 1:
        n = L.SINCE_DAYS_DEFAULT
    return F.to_date(_c(received)) >= F.date_sub(F.lit(as_of).cast("date"), n)
