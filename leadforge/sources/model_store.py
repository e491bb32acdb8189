"""Model save/load (S10) and import of the legacy single-document JSON model.

A saved model is a folder: ``terms/`` (parquet: kind, term, n_pos, n_neg) stays
a distributed table; ``meta/`` holds one JSON row of scalars (priors, totals,
vocabulary size, feature weights, threshold, algorithm, version, trained time).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.nb import BIGRAM, UNIGRAM, NBModel, table_bytes

LEGACY_SCHEMA = (
    "version INT, class_priors MAP<STRING, DOUBLE>, token_counts MAP<STRING, MAP<STRING, BIGINT>>, "
    "total_tokens MAP<STRING, BIGINT>, vocabulary_size BIGINT, bigram_counts MAP<STRING, MAP<STRING, BIGINT>>, "
    "feature_weights MAP<STRING, DOUBLE>"
)


def save_model(spark: SparkSession, model: NBModel, path: str, threshold: float | None = None,
               algorithm: str = "naive_bayes") -> None:
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    meta = {
        "algorithm": algorithm, "version": 2,
        "trained_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds"),
        "threshold": threshold if threshold is not None else model.threshold,
        "prior_pos": model.prior_pos, "prior_neg": model.prior_neg,
        "total_pos": model.total_pos, "total_neg": model.total_neg,
        "vocabulary_size": model.vocabulary_size, "use_ngrams": model.use_ngrams,
        "use_features": model.use_features, "feature_weights": json.dumps(model.weights),
        "term_bytes": model.term_bytes if model.term_bytes is not None else -1,
    }
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> NBModel:
    terms = spark.read.parquet(f"{path}/terms")
    m = spark.read.json(f"{path}/meta").first().asDict()  # one row of scalars
    return NBModel(terms, m["prior_pos"], m["prior_neg"], int(m["total_pos"]), int(m["total_neg"]),
                   int(m["vocabulary_size"]), json.loads(m["feature_weights"] or "{}"),
                   bool(m["use_ngrams"]), bool(m["use_features"]), m.get("threshold"),
                   term_bytes=None if m.get("term_bytes", -1) in (None, -1) else int(m["term_bytes"]))


def _counts(doc: DataFrame, field: str, kind: str) -> DataFrame:
    pos = doc.select(F.explode(F.col(field)["1"]).alias("term", "n_pos"))
    neg = doc.select(F.explode(F.col(field)["0"]).alias("term", "n_neg"))
    return pos.join(neg, "term", "full_outer").select(
        F.lit(kind).alias("kind"), "term",
        F.coalesce("n_pos", F.lit(0)).cast("long").alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).cast("long").alias("n_neg"))


COUNT_MAPS = (("token_counts", UNIGRAM), ("bigram_counts", BIGRAM))
ENTRY = "kind string, term string, n_pos bigint, n_neg bigint"


def plain_entries(text: str | None) -> list[tuple[str, str, tuple]] | None:
    """``[(kind, label, ((term, count), ..))]`` of a plain document: an object whose count maps hold whole numbers of
    64 bits. Anything else gives None and is left to ``from_json``, which says what an odd document means."""
    if text is None:
        return []
    if "\\ud" in text or "\\uD" in text:  # halves of a character
        return None
    try:
        doc = json.loads(text, object_pairs_hook=tuple)
    except (ValueError, RecursionError):
        return None
    found = []
    fields = dict(doc) if type(doc) is tuple else {}
    if type(doc) is not tuple or len(fields) != len(doc):
        return None
    for field, kind in COUNT_MAPS:
        labels = fields.get(field)
        if labels is None:
            continue
        if type(labels) is not tuple or len(dict(labels)) != len(labels):
            return None
        for label, counts in labels:
            if type(counts) is not tuple or any(type(n) is not int or not -(1 << 63) <= n < 1 << 63 for _, n in counts):
                return None
            if label in ("0", "1") and counts:
                found.append((kind, label, counts))
    return found


def _read_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, value) to a row for each count of a plain document; another one keeps its text."""
    names = ["model", "kind", "term", "n_pos", "n_neg", "value"]
    for batch in batches:
        for at in range(batch.num_rows):
            model, text = batch.column(0).slice(at, 1), batch.column(1)[at].as_py()
            found = plain_entries(text)
            if found is None:
                null, none = pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([model, null, null, none, none, pa.array([text])], names=names)
                continue
            for kind, label, counts in found:
                terms, numbers = zip(*counts)
                n, zero = pa.array(numbers, pa.int64()), pa.array([0] * len(terms), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    model.take(pa.array([0] * len(terms))), pa.array([kind] * len(terms)), pa.array(terms, pa.string()),
                    *((n, zero) if label == "1" else (zero, n)), pa.nulls(len(terms), pa.string())], names=names)


def legacy_terms(documents: DataFrame, model_col: str = "model", json_col: str = "value") -> DataFrame:
    """S10 for many models: version-2 JSON documents to ``(model, kind, term, n_pos, n_neg)`` in one job.

    A document is parsed in the row that holds it; its terms leave as rows. A document without count maps gives no
    row, nor does one that is not JSON. Terms are field names there: Spark's parser keeps every field name it ever
    met in one table of the process, so plain documents are read by the standard library, only odd ones by ``from_json``.
    """
    def entries(field: str, kind: str, label: str):
        counts = F.map_entries(F.try_element_at(F.col(f"m.{field}"), F.lit(label)))
        zero = F.lit(0).cast("bigint")
        found = F.transform(counts, lambda e: F.struct(
            F.lit(kind).alias("kind"), e["key"].alias("term"), (e["value"] if label == "1" else zero).alias("n_pos"),
            (e["value"] if label == "0" else zero).alias("n_neg")))
        return F.coalesce(found, F.array().cast(f"array<struct<{ENTRY}>>"))

    given = documents.select(F.col(model_col).alias("model"), F.col(json_col).alias("value"))
    schema = StructType([given.schema["model"], *StructType.fromDDL(f"{ENTRY}, value string").fields])
    read = given.mapInArrow(_read_plain, schema).withColumn("m", F.from_json("value", LEGACY_SCHEMA))
    plain = F.array(F.struct("kind", "term", "n_pos", "n_neg"))
    rows = F.when(F.col("value").isNull(), plain).otherwise(F.concat(*[entries(f, k, y) for f, k in COUNT_MAPS for y in "10"]))
    return (read.select("model", F.explode(rows).alias("r")).select("model", "r.*").groupBy("model", "kind", "term")
            .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")))


def load_legacy_folder(spark: SparkSession, path: str) -> DataFrame:
    """The terms of every ``.json`` model document of a folder, known by file path."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return legacy_terms(files.select(F.col("_metadata.file_path").alias("model"), "value"))


def import_legacy_json(spark: SparkSession, path: str, meta_path: str | None = None) -> NBModel:
    """Read a version-2 JSON model (one JSON document) into an ``NBModel``.

    The document is parsed by Spark and its count maps exploded into the term
    table; only the scalar header fields are read back to the driver. A
    metadata file, when given, supplies the threshold (0 is a valid threshold).
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", LEGACY_SCHEMA).alias("m")).select("m.*")
    terms = _counts(doc, "token_counts", UNIGRAM)
    has_bigrams = doc.select(F.col("bigram_counts").isNotNull().alias("b")).first()["b"]
    if has_bigrams:
        terms = terms.unionByName(_counts(doc, "bigram_counts", BIGRAM))
    head = doc.select(
        F.col("class_priors")["1"].alias("prior_pos"), F.col("class_priors")["0"].alias("prior_neg"),
        F.col("total_tokens")["1"].alias("total_pos"), F.col("total_tokens")["0"].alias("total_neg"),
        "vocabulary_size", F.to_json("feature_weights").alias("weights"),
    ).first()
    threshold = None
    if meta_path:
        meta = spark.read.json(meta_path, multiLine=True).first()
        if meta is not None and "threshold" in meta.asDict() and meta["threshold"] is not None:
            threshold = float(meta["threshold"])
    weights = json.loads(head["weights"]) if head["weights"] else {}
    return NBModel(terms, head["prior_pos"] or 1e-9, head["prior_neg"] or 1e-9, int(head["total_pos"] or 0),
                   int(head["total_neg"] or 0), int(head["vocabulary_size"] or 0), weights,
                   use_ngrams=bool(has_bigrams), use_features=bool(weights), threshold=threshold,
                   term_bytes=table_bytes(terms))
