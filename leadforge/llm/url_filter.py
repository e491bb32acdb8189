"""URL filter: a blocked Bloom filter in front of an exact hash join.

The list holds canonical entries of two kinds, in one key space:

* a *rule* ``host/path`` with a verdict, fitting its host and all subdomains
  where the url's path starts with the rule's path;
* a *url*: a canonical address (host without a leading ``www.`` plus path, ``/``
  if empty) that is blocked where no rule fits.

Every url is expanded into the few keys that could be listed (host suffixes of
the label counts and path prefixes of the lengths that occur among the rules,
and its canonical form). The Bloom filter passes possible hits, and a shuffled
hash join with the list removes the false ones. The longest rule wins; of rules
of equal length the one with the longer host, then ``block``.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; rows that repeat are all returned; a null id is
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .tables import materialise

#: (verdict, rule) as the list states them
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LIST_SCHEMA = "key string, rule string, verdict string, rule_length int, host_length int"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(path == "", F.lit("/")).otherwise(path))


def rule_list(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    rows = []
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        rows.append((f"r:{host}/{path}", rule, verdict, len(rule), len(host)))
    return spark.createDataFrame(rows, LIST_SCHEMA)


def url_list(urls: DataFrame, column: str = "url") -> DataFrame:
    """Canonical forms of listed addresses, as list entries."""
    host, path = host_of(urls[column]), path_of(urls[column])
    return (urls.filter(host != "").select(F.concat(F.lit("u:"), canonical(host, path)).alias("key"))
            .select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"),
                    F.lit(0).alias("rule_length"), F.lit(0).alias("host_length")))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``."""
    entries = (rules if listed is None else rules.unionByName(listed)).groupBy("key").agg(
        F.max("rule").alias("rule"), F.max("verdict").alias("verdict"),  # 'block' > 'allow'
        F.max("rule_length").alias("rule_length"), F.max("host_length").alias("host_length"))
    entries = materialise(entries, "url-list")
    shape = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(F.col("rule").isNotNull(), F.size(F.split(F.substring_index("rule", "/", 1), r"\.")))).alias("labels"),
        # path lengths, the leading slash included; distinct numbers, at most the longest path of a rule
        F.collect_set(F.when(F.col("rule").isNotNull(), F.col("rule_length") - F.col("host_length"))).alias("lengths"),
    ).first()

    urls = pages.groupBy(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url")).agg(
        F.count(F.lit(1)).alias("copies"))
    urls = materialise(urls.select("page_id", "url", "copies", host_of(F.col("url")).alias("host"),
                                   path_of(F.col("url")).alias("path")), "urls")

    keys = [F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path")))]
    for n in sorted(shape["labels"]):
        suffix = F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n))
        keys += [F.when(F.length("path") >= k, F.concat(F.lit("r:"), suffix, F.substring("path", 1, k)))
                 for k in sorted(shape["lengths"])]
    probes = urls.filter(F.col("host") != "").select(
        "page_id", "url", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    hits = bloom.possible(probes, F.col("key"), entries, F.col("key"), shape["n"]).filter("_possible").drop("_possible")
    found = hits.join(entries.hint("shuffle_hash"), "key")
    best = found.groupBy("page_id", "url").agg(
        F.max(F.struct("rule_length", "host_length", "verdict", "rule")).alias("best"))
    return (
        urls.alias("u").join(best.alias("b"), F.col("u.page_id").eqNullSafe(F.col("b.page_id"))
                             & F.col("u.url").eqNullSafe(F.col("b.url")), "left")
        .select("u.page_id", "u.url", "u.host", "u.path", "b.best.rule",
                F.coalesce("b.best.verdict", F.lit("allow")).alias("verdict"),
                F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("u.copies"))).alias("_copy"))
        .drop("_copy"))


def spam_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The pages whose host has a label that names itself spam."""
    return pages.filter(F.regexp_like(host_of(pages[url_col]), F.lit(r"(^|\.)spam[^.]*\.")))
