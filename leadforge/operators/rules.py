"""Keyword-lexicon lead scorer (R1-R5) and the negative-context veto.

The lexicon is a small driver-side configuration; it is compiled once into
literal arrays and a literal map that Catalyst folds into the expression, so
scoring is a per-row, shuffle-free projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.patterns import RULE_NON_WORD, WS
from ..functions.columns import let
from .text import _c


@dataclass
class Lexicon:
    keywords: list[str]
    lookup: dict[str, str]
    phrases: list[tuple[str, str]]
    negatives: list[str] = field(default_factory=list)
    stopwords: list[str] = field(default_factory=lambda: list(L.RULE_STOPWORDS))
    stems: list[tuple[str, str]] = field(default_factory=lambda: list(L.RULE_STEMS))
    threshold: float = L.RULE_THRESHOLD
    weights: tuple[float, float, float] = (L.WEIGHT_SUBJECT, L.WEIGHT_BODY, L.WEIGHT_HEADERS)


def _stem(token: str, stems) -> str:
    for prefix, stem in stems:
        if token.startswith(prefix):
            return stem
    return token


_PY_NON_WORD = re.compile(r"[^\w\s]")


def _py_tokens(text: str, lookup: dict[str, str], stems, stopwords) -> list[str]:
    out = []
    for part in _PY_NON_WORD.sub(" ", text.lower()).split():
        if part in stopwords:
            continue
        s = _stem(part, stems)
        out.append(lookup.get(s, s))
    return out


def compile_lexicon(
    keywords=None, synonyms=None, negative_keywords=None, threshold: float = L.RULE_THRESHOLD
) -> Lexicon:
    """Build keyword set, token lookup and phrase list.

    Phrases are normalised with the lookup as it stands when they are added, and
    later single-word synonyms overwrite earlier entries — so some phrases can
    never match, exactly like the original scorer.
    """
    stems, stop = L.RULE_STEMS, set(L.RULE_STOPWORDS)
    kw = [_stem(k.lower(), stems) for k in (keywords or L.RULE_KEYWORDS)]
    kw = list(dict.fromkeys(kw))
    lookup = {k: k for k in kw}
    phrases: list[tuple[str, str]] = []
    merged = {**L.RULE_SYNONYMS, **(synonyms or {})}
    for canonical, words in merged.items():
        c = _stem(canonical.lower(), stems)
        if c not in kw:
            kw.append(c)
        lookup.setdefault(c, c)
        for w in words:
            norm = " ".join(_py_tokens(w, lookup, stems, stop))
            if " " in norm:
                phrases.append((norm, c))
            else:
                lookup[_stem(norm, stems)] = c
    negatives = []
    for item in negative_keywords or ():
        norm = " ".join(_py_tokens(item, lookup, stems, stop))
        if norm:
            negatives.append(norm)
    return Lexicon(kw, lookup, phrases, negatives, threshold=threshold)


DEFAULT_LEXICON = compile_lexicon()


def rule_tokens(text, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """R2: lower, non-word chars to spaces, split, drop stopwords, stem, canonicalise."""
    clean = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), RULE_NON_WORD, " ")
    parts = F.filter(F.split(clean, f"{WS}+"), lambda x: x != "")
    kept = F.filter(parts, lambda x: ~x.isin(lex.stopwords))
    lookup = F.create_map(*[F.lit(v) for kv in lex.lookup.items() for v in kv])

    # hash-set gates: most tokens start with no stem prefix and are no lookup key
    heads = sorted({p[:4] for p, _ in lex.stems})
    keys = sorted(lex.lookup)

    def canon(x: Column) -> Column:
        expr = None
        for prefix, stem in lex.stems:
            expr = (F.when(x.startswith(prefix), F.lit(stem)) if expr is None
                    else expr.when(x.startswith(prefix), F.lit(stem)))
        stemmed = F.when(F.substring(x, 1, 4).isin(heads), expr.otherwise(x)).otherwise(x)
        return let(stemmed, lambda st: F.when(st.isin(keys), F.try_element_at(lookup, st)).otherwise(st))

    return F.transform(kept, canon)


def segment_score_of_tokens(tokens: Column, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """Count of distinct canonicals hit by a keyword token or a phrase substring."""
    kw_hits = F.filter(tokens, lambda t: t.isin(lex.keywords))
    joined = F.array_join(tokens, " ")
    if lex.phrases:
        phrase_hits = F.filter(
            F.array(*[F.when(joined.contains(p), F.lit(c)) for p, c in lex.phrases]),
            lambda x: x.isNotNull(),
        )
        hits = F.concat(kw_hits, phrase_hits)
    else:
        hits = kw_hits
    return F.size(F.array_distinct(hits)).cast("double")


def segment_score(text, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    return let(rule_tokens(text, lex), lambda t: segment_score_of_tokens(t, lex))


def subject_of(headers) -> Column:
    h = _c(headers)
    return F.coalesce(
        F.nullif(F.try_element_at(h, F.lit("Subject")), F.lit("")),
        F.nullif(F.try_element_at(h, F.lit("subject")), F.lit("")),
        F.lit(""),
    )


def other_headers(headers) -> Column:
    """Values of every non-null header except Subject (any case), space-joined in map order."""
    entries = F.filter(
        F.map_entries(_c(headers)),
        lambda e: (F.lower(e["key"]) != "subject") & e["value"].isNotNull(),
    )
    return F.array_join(F.transform(entries, lambda e: e["value"]), " ")


def _veto_of_tokens(token_cols, lex: Lexicon) -> Column:
    parts = [F.nullif(F.array_join(t, " "), F.lit("")) for t in token_cols]
    combined = F.concat_ws(" ", *parts)
    cond = None
    for p in lex.negatives:
        c = combined.contains(p)
        cond = c if cond is None else (cond | c)
    return cond


def negative_veto(subject, body, headers_text, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """any normalised negative phrase is a substring of the normalised message text."""
    if not lex.negatives:
        return F.lit(False)
    toks = F.struct(*[rule_tokens(x, lex).alias(n) for x, n in ((subject, "s"), (body, "b"), (headers_text, "h"))])
    return let(toks, lambda r: _veto_of_tokens([r["s"], r["b"], r["h"]], lex))


def rule_score_parts(headers, body, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """R4 + F4 as a struct ``(score, vetoed)``; each text is tokenised once per row.

    score = 2 x subject + 1 x body + 0.5 x other headers, zero when vetoed.
    """
    h = _c(headers)
    toks = F.struct(
        rule_tokens(subject_of(h), lex).alias("s"),
        rule_tokens(F.coalesce(_c(body), F.lit("")), lex).alias("b"),
        rule_tokens(other_headers(h), lex).alias("h"),
    )
    ws, wb, wh = lex.weights

    def score(r):
        raw = (segment_score_of_tokens(r["s"], lex) * ws + segment_score_of_tokens(r["b"], lex) * wb
               + segment_score_of_tokens(r["h"], lex) * wh)
        veto = _veto_of_tokens([r["s"], r["b"], r["h"]], lex) if lex.negatives else F.lit(False)
        return F.struct(F.when(veto, F.lit(0.0)).otherwise(raw).alias("score"), veto.alias("vetoed"))

    return let(toks, score)


def rule_score(headers, body, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """Rule score of a message (headers map + body)."""
    return rule_score_parts(headers, body, lex)["score"]


def with_rule_score(df: DataFrame, headers, body, lex: Lexicon = DEFAULT_LEXICON,
                    out: str = "rule_score", veto_col: str | None = None) -> DataFrame:
    """Add ``out`` (and optionally the veto flag) to a frame."""
    t = df.withColumn("_rule", rule_score_parts(headers, body, lex))
    cols = [F.col("_rule.score").alias(out)]
    if veto_col:
        cols.append(F.col("_rule.vetoed").alias(veto_col))
    return t.select(*df.columns, *cols)


def rule_is_lead(score, lex: Lexicon = DEFAULT_LEXICON) -> Column:
    """Score at or above the threshold."""
    return _c(score) >= F.lit(lex.threshold)
