from pyspark.sql import functions as F

from conftest import one
from leadforge.operators import rules


def score(spark, subject, body, lex=rules.DEFAULT_LEXICON):
    return one(spark, rules.rule_score(F.col("h"), F.col("b"), lex), h={"Subject": subject}, b=body)


def test_subject_weighting(spark):
    assert score(spark, "Quote request for services", "") == 4.0


def test_body_phrases(spark):
    assert score(spark, "", "Vorremmo una quotazione e un'offerta dettagliata") == 2.0
    assert score(spark, "", "Vorremmo solo una quotazione") == 1.0


def test_each_canonical_counts_once(spark):
    assert score(spark, "", "prezzi, prezzo, price") == 1.0
    # "costi e pricing" normalises to the phrase "prezzo e prezzo", a second canonical
    assert score(spark, "", "prezzi e pricing") == 2.0


def test_prefix_stems(spark):
    toks = one(spark, F.array_join(rules.rule_tokens(F.col("t")), " "), t="Costruzione del quotidiano")
    # costruzione -> costo (prefix stem) -> prezzo (a later synonym entry overwrites the lookup)
    assert toks == "prezzo del quotazione"


def test_negative_veto(spark):
    lex = rules.compile_lexicon(negative_keywords=["non interessati"])
    assert score(spark, "Richiesta preventivo", "Grazie ma non interessati", lex) == 0.0
    assert score(spark, "Richiesta preventivo", "Grazie", lex) == 2.0  # one canonical, subject weight 2


def test_other_headers_count_half(spark):
    s = one(spark, rules.rule_score(F.col("h"), F.col("b")), h={"Subject": "", "X-Note": "listino"}, b="")
    assert s == 0.5
