"""Classifier text features, naive-Bayes training and scoring.

Training is ``explode -> groupBy(kind, term)`` with map-side partial
aggregation, so a very frequent term costs one partial row per task rather than
one task holding all of its rows. Scoring needs the log odds of a message's
terms only. A message's terms are counted beside its text; those the model saw
most often (a bounded number) are valued there, the others are shuffled by term
and joined with the model. A model within the broadcast budget is broadcast; one
beyond it is written in buckets of its terms, and the messages are scored in a
fixed number of slices, so that the shuffle files of one slice are on disk at a
time. The driver gets the one-row model statistics and the most frequent terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import lexicon as L
from ..functions.columns import let
from ..functions.patterns import HAS_EMAIL, HAS_FEATURE_PHONE, ML_TOKEN, WORD_AND_WS
from ..session import scratch_path, scratch_table, shuffles_freed, written, written_in_buckets
from .text import _c, strip_ws

UNIGRAM, BIGRAM = "uni", "bi"


# ---------------------------------------------------------------------------
# Tokens, bigrams, numeric features
# ---------------------------------------------------------------------------

def ml_tokens(text, legacy_train: bool = False) -> Column:
    """M1: ``[\\w']+`` tokens of the lower-cased text, minus stopwords, longer than 2 chars."""
    stop = L.ml_stopwords(legacy_train)
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(ML_TOKEN), 0)
    return F.filter(found, lambda t: (F.char_length(t) > 2) & ~t.isin(stop))


def bigrams(tokens) -> Column:
    """M2: adjacent token pairs joined by a space."""
    t = _c(tokens)
    return F.when(F.size(t) >= 2, F.transform(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1))), lambda x, i: F.concat(x, F.lit(" "), t[i + 1])
    )).otherwise(F.array().cast("array<string>"))


def _count_substrings(low: Column, words) -> Column:
    return sum((F.when(low.contains(w), F.lit(1)).otherwise(F.lit(0)) for w in words), F.lit(0))


def text_features(text, legacy_train: bool = False) -> Column:
    """M3: struct of the six numeric features (serving definition unless ``legacy_train``)."""
    def signature_score(lines):
        def hits(ls):
            return F.size(F.filter(ls, lambda line: let(
                F.lower(line), lambda lw: _count_substrings(lw, L.SIGNATURE_INDICATORS) > 0)))

        def in_window(last5):
            if legacy_train:
                return hits(last5) / 5.0
            window = let(F.filter(last5, lambda line: strip_ws(line) != ""),
                         lambda nonblank: F.when(F.size(nonblank) > 0, nonblank).otherwise(last5))
            return let(window, lambda w: hits(w) / F.greatest(F.size(w), F.lit(1)))
        return let(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5), in_window)

    def build(r):
        t, low, words = r["t"], r["low"], r["words"]
        urgency = F.least(_count_substrings(low, L.URGENCY_WORDS) / 3.0, F.lit(1.0))
        greeting = F.when(_count_substrings(low, L.GREETING_WORDS) > 0, 1.0).otherwise(0.0)
        questions = F.when(t.contains("?"), F.char_length(t) - F.char_length(F.replace(t, F.lit("?"), F.lit("")))).otherwise(F.lit(0))
        density = F.least(questions / F.greatest(words / 50.0, F.lit(1.0)), F.lit(1.0))
        length = F.least(words / 200.0, F.lit(1.0))
        contact = F.when(t.rlike(HAS_FEATURE_PHONE) | (t.contains("@") & t.rlike(HAS_EMAIL)), 1.0).otherwise(0.0)
        return F.struct(
            urgency.cast("double").alias("urgency_score"),
            greeting.cast("double").alias("has_greeting"),
            density.cast("double").alias("question_density"),
            length.cast("double").alias("length_score"),
            contact.cast("double").alias("has_contact_info"),
            let(F.split(t, "\n", -1), signature_score).cast("double").alias("signature_score"),
        )

    def bind(t):
        words = F.char_length(F.regexp_replace(strip_ws(t), WORD_AND_WS, "x"))  # as many as Python's str.split() finds
        return let(F.struct(t.alias("t"), F.lower(t).alias("low"), words.alias("words")), build)
    return let(F.coalesce(_c(text), F.lit("")), bind)


def feature_tokens(features) -> Column:
    """Pseudo tokens ``__feat_<name>`` repeated round-half-even(3 v) times (min 1) for v > 0."""
    f = _c(features)
    parts = [
        F.when(f[n] > 0, F.array_repeat(F.lit(f"__feat_{n}"),
                                        F.greatest(F.bround(f[n] * 3, 0).cast("int"), F.lit(1))))
        .otherwise(F.array().cast("array<string>"))
        for n in L.FEATURE_NAMES
    ]
    return F.concat(*parts)


# ---------------------------------------------------------------------------
# M4-M6: training tables
# ---------------------------------------------------------------------------

def with_terms(df: DataFrame, text_col: str, use_ngrams: bool = True, legacy_train: bool = False) -> DataFrame:
    """Add ``_tok`` (unigrams) and ``_big`` (bigrams) array columns."""
    out = df.withColumn("_tok", ml_tokens(text_col, legacy_train))
    big = bigrams(F.col("_tok")) if use_ngrams else F.array().cast("array<string>")
    return out.withColumn("_big", big)


def class_term_counts(train: DataFrame, text_col: str = "text", label_col: str = "label",
                      use_ngrams: bool = True, legacy_train: bool = False) -> DataFrame:
    """M4: (kind, term, n_pos, n_neg) over the training rows."""
    t = with_terms(train.select(label_col, text_col), text_col, use_ngrams, legacy_train)
    kinds = [F.struct(F.lit(UNIGRAM).alias("kind"), F.col("_tok").alias("terms"))]
    if use_ngrams:
        kinds.append(F.struct(F.lit(BIGRAM).alias("kind"), F.col("_big").alias("terms")))
    e = (
        t.select(F.col(label_col).alias("label"), F.explode(F.array(*kinds)).alias("k"))
        .select("label", F.col("k.kind").alias("kind"), F.explode("k.terms").alias("term"))
    )
    return e.groupBy("kind", "term").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )


def nb_stats(train: DataFrame, terms: DataFrame, label_col: str = "label") -> DataFrame:
    """M5: long table (stat, value) — priors, unigram totals per class, vocabulary size."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    n_pos = F.count_if(F.col(label_col) == 1)
    docs = train.agg(
        F.array(
            F.struct(F.lit("prior_pos").alias("stat"), (n_pos / total).cast("double").alias("value")),
            F.struct(F.lit("prior_neg").alias("stat"), ((F.count(F.lit(1)) - n_pos) / total).cast("double").alias("value")),
        ).alias("s"))
    uni = terms.filter(F.col("kind") == UNIGRAM).agg(
        F.array(
            F.struct(F.lit("total_pos").alias("stat"), F.coalesce(F.sum("n_pos"), F.lit(0)).cast("double").alias("value")),
            F.struct(F.lit("total_neg").alias("stat"), F.coalesce(F.sum("n_neg"), F.lit(0)).cast("double").alias("value")),
            F.struct(F.lit("vocabulary_size").alias("stat"), F.count(F.lit(1)).cast("double").alias("value")),
        ).alias("s"))
    return docs.unionByName(uni).select(F.explode("s").alias("x")).select("x.stat", "x.value")


def feature_weights(train: DataFrame, text_col: str = "text", label_col: str = "label",
                    legacy_train: bool = False) -> DataFrame:
    """M6: (feature, weight) with weight = 2 x (mean over positives - mean over negatives)."""
    f = train.select(F.col(label_col).alias("label"), text_features(text_col, legacy_train).alias("f"))
    aggs = [F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")]
    for n in L.FEATURE_NAMES:
        aggs.append(F.sum(F.when(F.col("label") == 1, F.col(f"f.{n}")).otherwise(0.0)).alias(f"p_{n}"))
        aggs.append(F.sum(F.when(F.col("label") == 0, F.col(f"f.{n}")).otherwise(0.0)).alias(f"q_{n}"))
    s = f.agg(*aggs)
    pos, neg = F.greatest(F.col("n_pos"), F.lit(1)), F.greatest(F.col("n_neg"), F.lit(1))
    stack = F.array(*[
        F.struct(F.lit(n).alias("feature"),
                 ((F.col(f"p_{n}") / pos - F.col(f"q_{n}") / neg) * 2.0).alias("weight"))
        for n in L.FEATURE_NAMES
    ])
    return s.select(F.explode(stack).alias("w")).select("w.feature", "w.weight")


# ---------------------------------------------------------------------------
# model
# ---------------------------------------------------------------------------

@dataclass
class NBModel:
    """A trained model: the term table stays distributed; statistics are scalars."""

    terms: DataFrame
    prior_pos: float
    prior_neg: float
    total_pos: int
    total_neg: int
    vocabulary_size: int
    weights: dict[str, float] = field(default_factory=dict)
    use_ngrams: bool = True
    use_features: bool = True
    threshold: float | None = None
    term_bytes: int | None = None     # size of ``terms`` in memory (checked before any broadcast)


def train_nb(train: DataFrame, text_col: str = "text", label_col: str = "label", use_ngrams: bool = True,
             use_features: bool = True, legacy_train: bool = False, persist_terms: DataFrame | None = None,
             materialize: bool = True) -> NBModel:
    """M4-M6. ``persist_terms`` lets a caller pass the term table it wrote out.

    With ``materialize`` the term table is written into the shared checkpoint
    folder once, so the statistics and every later scoring job read it instead of
    re-tokenising the training set; the shuffle files it took are gone then.
    """
    # read three times, and its rows may come from a join: written once, so that the join's files are gone before the terms'
    with scratch_table(train.select(label_col, text_col), "nb-train", materialize) as rows:
        terms = persist_terms if persist_terms is not None else class_term_counts(
            rows, text_col, label_col, use_ngrams, legacy_train)
        if materialize and persist_terms is None:
            terms = written(terms, "nb-terms")
        term_bytes = table_bytes(terms) if materialize else None
        st = {r["stat"]: r["value"] for r in nb_stats(rows, terms, label_col).collect()}  # five rows
        weights = {}
        if use_features:
            weights = {r["feature"]: r["weight"] for r in
                       feature_weights(rows, text_col, label_col, legacy_train).collect()}
    return NBModel(terms, st["prior_pos"], st["prior_neg"], int(st["total_pos"]), int(st["total_neg"]),
                   int(st["vocabulary_size"]), weights, use_ngrams, use_features, term_bytes=term_bytes)


# ---------------------------------------------------------------------------
# M7-M8: scoring
# ---------------------------------------------------------------------------

def nb_score(df: DataFrame, model: NBModel, id_col: str, text_col: str, out: str = "nb_score",
             carry: list[str] = ()) -> DataFrame:
    """M7: (id, score) — two-class naive-Bayes probability with smoothing and feature shifts.

    log P(c|d) = ln prior_c + sum_t n_t ln((c_t+1)/(N_c+V)) + 0.5 sum_b n_b ln((c_b+1)/(N_c+V)) + shift_c
    The score follows from the difference of both classes. Its per-term part is split as
    ln((p_t+1)/(q_t+1)) - ln((N_p+V)/(N_q+V)): unknown terms add only the second part, which the
    message's own term count supplies. Messages without tokens score 0.
    """
    spark, carry = df.sparkSession, list(carry)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carry)
    frequent, odds, slices = None, term_odds(model.terms), 1
    if model.term_bytes is None or not 0 <= model.term_bytes <= broadcast_budget(spark):
        least, frequent = frequent_terms(odds)
        odds, slices = odds.filter(F.col("n") < least), score_slices(docs)
    odds = odds.filter("odds <> 0").select("term", "odds")
    if slices == 1:
        s = _log_odds(docs, sized_for_join(odds, model.term_bytes, spark), model, frequent, carry)
    else:
        table = written_in_buckets(odds, "term", join_partitions(model.term_bytes, spark), "nb-odds").hint("shuffle_hash")
        path = scratch_path(spark, "nb-scores")
        for k in range(slices):
            part = _log_odds(docs.filter(F.pmod(F.xxhash64("_id"), F.lit(slices)) == k), table, model, frequent, carry)
            with shuffles_freed(spark):
                part.write.mode("append").parquet(path)
            schema = part.schema
        s = spark.read.schema(schema).parquet(path)
    prior = math.log(model.prior_pos or 1e-9) - math.log(model.prior_neg or 1e-9)
    log_odds = F.col("_odds") + F.lit(prior) + 1.5 * F.col("_shift")
    prob = F.when(F.col("_any"), 1.0 / (1.0 + F.exp(-log_odds))).otherwise(F.lit(0.0))
    return s.select(F.col("_id").alias(id_col), *carry, prob.alias(out))


def _log_odds(docs: DataFrame, odds: DataFrame, model: NBModel, frequent: tuple | None, carry: list[str]) -> DataFrame:
    """(_id, carry, _any, _shift, _odds) of docs (_id, _text, carry): whether there are tokens, the
    features' shift and the sum over the terms."""
    V = max(1, model.vocabulary_size)
    den_pos = math.log(model.total_pos + V) if model.total_pos + V > 0 else 0.0
    den_neg = math.log(model.total_neg + V) if model.total_neg + V > 0 else 0.0
    shift = F.lit(0.0)
    if model.use_features and model.weights:
        shift = let(text_features("_text"), lambda f: sum(
            (f[n] * F.lit(float(model.weights.get(n, 0.0))) for n in L.FEATURE_NAMES), F.lit(0.0)))
    # the message's own values ride on one row under a key that is no term; it meets no other key
    given = docs.withColumn("_tok", ml_tokens("_text")).select(
        "_id", F.concat(F.lit(" "), F.col("_id").cast("string")).alias("term"), "_tok",
        F.struct((F.size("_tok") > 0).alias("_any"), shift.alias("_shift"), *carry).alias("_doc"))
    fields = {f.name: f.dataType for f in given.schema}
    schema = StructType([StructField(n, t) for n, t in [
        ("_id", fields["_id"]), ("term", fields["term"]), ("_doc", fields["_doc"])]]).add("_n", "double").add("_part", "double")
    use_ngrams, den = model.use_ngrams, den_pos - den_neg

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                yield counted_terms(batch.slice(at, DOCS_AT_ONCE), use_ngrams, den, frequent)
    met = given.mapInArrow(counted, schema).join(odds, "term", "left")
    value = F.coalesce("_part", F.col("_n") * F.col("odds"))
    return met.select("_id", "_doc", value.alias("_value")).filter("_value IS NOT NULL").groupBy("_id").agg(
        *[F.max(f"_doc.{c}").alias(c) for c in [*carry, "_any", "_shift"]], F.sum("_value").alias("_odds"))


DOCS_AT_ONCE = 256  # documents whose terms are counted in one go


def counted_terms(batch: pa.RecordBatch, use_ngrams: bool, den: float, frequent: tuple | None) -> pa.RecordBatch:
    """Rows of (_id, term, _doc, _n, _part) from (_id, term, _tok, _doc): one with ``_part`` for each document, and
    one with the weighted count ``_n`` for each of its distinct terms that is not among the ``frequent`` (terms, odds).
    ``_part`` holds these and ``-den`` for every term."""
    ids, own = batch.column("_id"), batch.column("_doc")
    terms, owner, codes, times, unit = distinct_terms(batch.column("_tok"), use_ngrams)
    some, n = batch.num_rows, times * unit[codes]
    part = -den * np.bincount(owner, weights=n, minlength=some)
    if frequent is not None and len(owner):
        known, odds = frequent
        at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)[codes]
        there = at >= 0
        part += np.bincount(owner[there], weights=n[there] * odds[at[there]], minlength=some)
        owner, codes, n = owner[~there], codes[~there], n[~there]
    rest = len(owner)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([ids, ids.take(pa.array(owner))]),
        pa.concat_arrays([batch.column("term"), terms.take(pa.array(codes))]),
        pa.concat_arrays([own, pa.nulls(rest, own.type)]),
        pa.concat_arrays([pa.nulls(some, pa.float64()), pa.array(n, pa.float64())]),
        pa.concat_arrays([pa.array(part, pa.float64()), pa.nulls(rest, pa.float64())]),
    ], ["_id", "term", "_doc", "_n", "_part"])


def distinct_terms(tokens: pa.ListArray, use_ngrams: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, owner, code, times, unit): the distinct words and bigrams of each list of tokens, as the list's place,
    the term's place in ``terms`` and how often it occurs; ``unit`` is the weight of each of ``terms``, 0.5 for bigrams."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words, owner = tokens.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.flatnonzero(owner[1:] == owner[:-1]) if use_ngrams else np.array([], dtype=np.int64)
    joined = pc.binary_join_element_wise(words.take(pa.array(pairs)), words.take(pa.array(pairs + 1)), " ")
    coded = pa.concat_arrays([words, joined]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.ones(len(coded.dictionary))
    unit[codes[len(words):]] = 0.5
    width = max(1, len(unit))
    key, times = np.unique(np.concatenate([owner, owner[pairs]]) * width + codes, return_counts=True)
    return coded.dictionary, key // width, key % width, times, unit


def term_odds(terms: DataFrame) -> DataFrame:
    """(term, n, odds) of a model's terms: how often it was seen, and the difference of its classes' logarithms.
    A bigram is told from a word by its space; a term that a text cannot have (a space elsewhere) is left out."""
    space = F.instr("term", " ")
    fits = F.when(F.col("kind") == UNIGRAM, space == 0).otherwise((F.col("kind") == BIGRAM) & (space > 1))
    part = [F.coalesce(F.log(F.col(c) + 1.0), F.lit(0.0)) for c in ("n_pos", "n_neg")]
    n = F.coalesce("n_pos", F.lit(0)) + F.coalesce("n_neg", F.lit(0))
    return terms.filter(fits).select("term", n.alias("n"), (part[0] - part[1]).alias("odds"))


FREQUENT = 100_000  # terms that are valued beside the text; some 10 MB in a task


def frequent_terms(odds: DataFrame) -> tuple[int, tuple[pa.Array, np.ndarray] | None]:
    """The count from which on there are at most ``FREQUENT`` terms, and these terms with their odds."""
    n = F.least("n", F.lit(FREQUENT))  # so many rows at most
    least, total = FREQUENT + 1, 0
    for r in sorted(odds.groupBy(n.alias("n")).count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["n"]
    if least > FREQUENT:
        return 1 << 62, None
    found = odds.filter(F.col("n") >= least).select("term", "odds").toArrow().combine_chunks()
    if found.num_rows == 0:
        return 1 << 62, None
    return least, (found["term"].combine_chunks().cast(pa.string()), found["odds"].to_numpy())


SLICES = 3                # parts in which messages are scored against a large model
SLICE_BYTES = 64 << 20    # texts up to this size are one part


def score_slices(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("_text")).alias("b")).first()["b"] or 0
    return SLICES if size > SLICE_BYTES else 1


def join_partitions(n_bytes: int | None, spark) -> int:
    """Buckets of a large term table: one fits a task's hash table, and there are no more than work or memory need,
    since each holds a row for nearly every message afterwards."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_bytes is None:
        return parts
    return max(min(parts, 2 * spark.sparkContext.defaultParallelism), math.ceil(n_bytes / HASH_PARTITION_BYTES))


HASH_PARTITION_BYTES = 128 << 20  # a partition of the term table that a task may hold as a hash table
BYTES_PER_TERM_ROW = 60  # kind, two counts and hash-table overhead, beside the term text


def table_bytes(terms: DataFrame) -> int:
    """Memory that the term table takes once broadcast, from its rows and text lengths (one action)."""
    size = F.count(F.lit(1)) * BYTES_PER_TERM_ROW + F.coalesce(F.sum(F.octet_length("term")), F.lit(0))
    return terms.agg(size.alias("b")).first()["b"]


def broadcast_budget(spark) -> int:
    budget = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        return int(str(budget).lower().rstrip("b"))
    except ValueError:
        return 10 * 1024 * 1024


def sized_for_join(terms: DataFrame, n_bytes: int | None, spark) -> DataFrame:
    """Broadcast the term table only when its checked size fits the session's
    broadcast budget; otherwise request a shuffle join, so a mis-estimated large
    model is never shipped to every executor. The messages' terms are many times the
    model's rows: they are not sorted as long as a partition of the model fits a task."""
    if n_bytes is not None and 0 <= n_bytes <= broadcast_budget(spark):
        return F.broadcast(terms)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_bytes is not None and n_bytes <= parts * HASH_PARTITION_BYTES:
        return terms.hint("shuffle_hash")
    return terms.hint("merge")


def nb_decision(score, model: NBModel | None = None, threshold: float = L.ML_THRESHOLD) -> Column:
    """M8: score at or above the model's stored threshold, else the configured one."""
    t = model.threshold if (model is not None and model.threshold is not None) else threshold
    return _c(score) >= F.lit(float(t))
