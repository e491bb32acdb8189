"""Training-set augmentation (M10) and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import let
from ..functions.patterns import WORD_CHARS
from . import nb as NB
from .text import _c


def _word(word: str) -> str:
    return rf"(?i)(?<![{WORD_CHARS}]){word}(?![{WORD_CHARS}])"


def augment_variants(label, subject, body, max_records: int = 3) -> Column:
    """array<struct(variant, label, subject, body)> — the record, then up to two
    synonym variants (label-1 records only). Each variant swaps one trigger word
    (whole-word, any case) for its first synonym in both fields; unchanged
    variants are dropped."""
    s, b = F.coalesce(_c(subject), F.lit("")), F.coalesce(_c(body), F.lit(""))
    variants = []
    for word, repl in L.AUGMENT_SYNONYMS.items():
        ns = F.regexp_replace(s, _word(word), repl[0])
        nb_ = F.regexp_replace(b, _word(word), repl[0])
        trig = F.lower(s).contains(word) | F.lower(b).contains(word)
        variants.append(F.when((_c(label) == 1) & trig & ((ns != s) | (nb_ != b)),
                               F.struct(_c(label).alias("label"), ns.alias("subject"), nb_.alias("body"))))
    original = F.struct(_c(label).alias("label"), _c(subject).alias("subject"), _c(body).alias("body"))
    kept = F.slice(F.filter(F.array(original, *variants), lambda v: v.isNotNull()), 1, max_records)
    return F.transform(kept, lambda v, i: F.struct(i.alias("variant"), v["label"].alias("label"),
                                                   v["subject"].alias("subject"), v["body"].alias("body")))


def augment(records: DataFrame, id_col: str = "id") -> DataFrame:
    a = records.select(id_col, F.explode(augment_variants("label", "subject", "body")).alias("v"))
    return a.select(id_col, "v.variant", "v.label", "v.subject", "v.body")


def doc_term_counts(df: DataFrame, id_col: str, text_col: str, use_ngrams: bool = True) -> DataFrame:
    """(id, term, tf) rows. Only texts are shuffled, so that rows with one id are one document; a
    document's terms are sorted and counted by the places where a new term begins, inside its row."""
    def terms_of(text):
        return let(NB.ml_tokens(text), lambda t: F.concat(t, NB.bigrams(t)) if use_ngrams else t)

    def counted(terms):
        begins = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (terms[i] != terms[F.greatest(i - 1, F.lit(0))]))
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(
            terms[at].alias("term"), (F.coalesce(F.get(b, k + 1), F.size(terms)) - at).alias("tf"))))

    by_doc = df.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts"))
    terms = by_doc.select(id_col, F.sort_array(F.flatten(F.transform("_texts", terms_of))).alias("_terms"))
    counts = terms.filter(F.size("_terms") > 0).select(id_col, F.explode(let(F.col("_terms"), counted)).alias("t"))
    return counts.select(id_col, "t.term", "t.tf")


def tfidf_weights(df: DataFrame, id_col: str = "id", text_col: str = "text", use_ngrams: bool = True) -> DataFrame:
    """(id, term, weight) — raw tf x smooth idf (ln((1+n)/(1+df)) + 1), L2-normalised per document.

    Rows of (id, term, tf) are shuffled twice: by term, where df is the number of a term's rows
    (one a document, so the most frequent term has as many as there are documents), and by id for
    the norms. Both counts travel instead of the weight. Only the document count n comes back to the driver.
    """
    tf = doc_term_counts(df, id_col, text_col, use_ngrams)
    n = df.select(id_col).distinct().count()
    met = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
    back = met.repartition(id_col)
    w = back.select(id_col, "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", F.when(norm > 0, F.col("raw") / norm).otherwise(0.0).alias("weight"))
