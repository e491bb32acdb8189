"""Registered queries of the training-data operators: ``opN_<name>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, exact_dedup, licenses, ngram_join, packing, periodic_runs, quality, secret_scan, spelling,
               substring_dedup, suffix_dedup, toxicity, url_filter)
from .tables import materialise, read_table


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = url_filter.url_list(url_filter.spam_hosts(pages))
    judged = url_filter.filter_urls(pages, url_filter.rule_list(spark), listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, secret_scan.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *count, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeat_tails(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("longest", periodic_runs.longest("runs"))
    length, period = F.col("longest.length"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = materialise(spelling.word_counts(docs, drop_one_in=97), "vocabulary")
    return spelling.spelling_variants(words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_packing": op10_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
