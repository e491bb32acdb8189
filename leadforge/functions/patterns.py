"""Regular expressions shared by the Spark (Java regex) plans and the SQL oracle (RE2).

Each pattern is spelled so that Java's engine and RE2 read it the same way and
both agree with Python's Unicode-aware ``re`` module on word, digit and
whitespace classes: ``\\w``, ``\\d`` and ``\\s`` are written out as explicit
Unicode classes, because the three engines give the short forms different
meanings (Java and RE2 default to ASCII). Only leftmost-first matching is used,
which all engines share.
"""

from __future__ import annotations

# Python str.isspace() characters.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHARS = r"\p{L}\p{N}_"
WORD = rf"[{WORD_CHARS}]"
DIGIT = r"\p{Nd}"

# The same set as a plain string (for character-set trims), derived from str.isspace().
WS_SET = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Python str.splitlines() boundaries (\r\n counts as one).
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# FIXED VALUES (patterns) — the original expressions, re-spelled with the classes above.
# email:            [\w\.-]+@[\w\.-]+\.\w+
EMAIL = rf"[{WORD_CHARS}.-]+@[{WORD_CHARS}.-]+\.{WORD}+"
# phone:            (?:\+?\d{{1,3}}[\s.-]?)?(?:\(?\d{{1,4}}\)?[\s.-]?)?\d[\d\s().-]{{6,}}\d
PHONE = (
    rf"(?:\+?{DIGIT}{{1,3}}[{WS_CHARS}.-]?)?(?:\(?{DIGIT}{{1,4}}\)?[{WS_CHARS}.-]?)?"
    rf"{DIGIT}[{DIGIT}{WS_CHARS}().-]{{6,}}{DIGIT}"
)
# feature "phone pattern":  \+?\d[\d\s().-]{7,}
FEATURE_PHONE = rf"\+?{DIGIT}[{DIGIT}{WS_CHARS}().-]{{7,}}"
# whether EMAIL or FEATURE_PHONE matches anywhere: the shortest core of a match, found in one pass
HAS_EMAIL = rf"[{WORD_CHARS}.-]@[{WORD_CHARS}.-]+\.{WORD}"
HAS_FEATURE_PHONE = rf"{DIGIT}[{DIGIT}{WS_CHARS}().-]{{7}}"
# a run without white space and the white space behind it; ASCII first, which spares most characters the ranges
WORD_AND_WS = rf"[!-~[^{WS_CHARS}]]+[ [{WS_CHARS}]]*"
# classifier token:  [\w']+
ML_TOKEN = rf"[{WORD_CHARS}']+"
# rule tokenizer: anything that is not a word or space character becomes a space
RULE_NON_WORD = rf"[^{WORD_CHARS}{WS_CHARS}]"


def sql_str(value: str) -> str:
    """Quote a Python string as a SQL string literal (no backslash escapes)."""
    return "'" + value.replace("'", "''") + "'"
