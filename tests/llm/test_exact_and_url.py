import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from leadforge.llm import bloom, exact_dedup, keep, url_filter

from .conftest import ODD


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[n] if x is not None]
        first = min(ids) if ids else None
        out.append((i, first, len(groups[n]), i == first, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_matches_brute_force(spark, odd, docs_of):
    rows = [*ODD, (20, "a  b\tc"), (21, "a b c"), (22, " a b c"), *[(30 + i, "hot") for i in range(40)]]
    got = exact_dedup.exact_dedup(spark, docs_of(rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(rows)


def test_index_persists_between_batches(spark, docs_of):
    index = exact_dedup.open_index(spark, buckets=4)
    exact_dedup.dedup(docs_of([(1, "a"), (2, "b")]), index).collect()
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(docs_of([(3, "a"), (4, "c"), (5, "c")]), index).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert sorted(r["keep_id"] for r in index.read().collect()) == [1, 2, 4]


def test_keep_first_hands_rows_through(spark, docs_of, empty):
    docs = docs_of([(1, "a"), (1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")])
    got = exact_dedup.keep_first(docs, exact_dedup.open_index(spark, buckets=2))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5]
    assert exact_dedup.keep_first(empty, exact_dedup.open_index(spark, buckets=2)).count() == 0


def test_keep_first_decides_by_id_and_text(spark, docs_of):
    """Null and repeated ids, of which only some texts are copies."""
    rows = [(1, "a"), (None, "a"), (None, "b"), (None, "c"), (None, "c"), (2, "a"), (2, "d"), (3, "e"), (3, "f"), (4, "e"), (5, "g h"), (5, "g  h")]
    got = exact_dedup.keep_first(docs_of(rows), exact_dedup.open_index(spark, buckets=2)).collect()
    assert sorted(((r["doc_id"] or 0, " ".join(r["text"].split())) for r in got)) == [
        (0, "b"), (0, "c"), (1, "a"), (2, "d"), (3, "e"), (3, "f"), (5, "g h")]


def test_bloom_filter_never_misses(spark):
    members = spark.range(0, 500).withColumnRenamed("id", "k")
    probed = bloom.possible(spark.range(0, 5000), F.col("id"), members, F.col("k"), 500)
    rows = {r["id"]: r["_possible"] for r in probed.collect()}
    assert len(rows) == 5000 and all(rows[i] for i in range(500)) and sum(rows.values()) < 700


URLS = ["https://a.net/x", "http://www.example.net/en/1?q#f", "http://example.net/de/", "HTTP://M.Example.COM/de/x", "http://x.org/fr/",
        "http://x.org/en/", "http://org", "http://net?x", "http://notexample.net.org/en/", "mailto:x", "", None, "http:///p", "http://a.net#z",
        "http://spam.bad.org/a?x=1", "http://www.spam.bad.org/a", "x://y://z/w", "http://example.com/de"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), v, r) for v, r in url_filter.RULES for h, _, p in [r.partition("/")]
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, default=(0, None, None))


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:3])], "page_id bigint, url string, host string")
    listed = url_filter.url_list(url_filter.spam_hosts(pages))
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, url_filter.rule_list(spark), listed).collect()}
    assert len(got) == len(URLS) + 3
    for i, u in enumerate(URLS):
        host, path, (_, verdict, rule) = judge(u)
        want = verdict or ("block" if "spam." in host else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, want), u


def test_url_filter_keeps_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id bigint, url string")
    assert url_filter.filter_urls(pages, url_filter.rule_list(spark)).count() == 3
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_list(spark)).count() == 0


def test_drop_losers_only_drops_decided(spark, docs_of):
    docs = docs_of([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d")])
    decided = spark.createDataFrame([(1, False), (2, True)], "doc_id bigint, stays boolean")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in keep.drop_losers(docs, decided).collect()) == [(0, "d"), (2, "b"), (3, "c")]


def test_a_batch_that_runs_again_keeps_the_same_rows(spark, docs_of):
    index = exact_dedup.open_index(spark)
    first = docs_of([(1, "a x"), (2, "a  x"), (3, "b"), (None, "c")])

    def kept(rows, batch):
        return {r["doc_id"]: r["kept"] for r in exact_dedup.dedup(rows, index, batch=batch).collect()}
    once = kept(first, "monday")
    assert once == {1: True, 2: False, 3: True, None: True}
    assert kept(first, "monday") == once and index.read().count() == 3
    assert kept(docs_of([(1, "a\tx"), (9, "d")]), "tuesday") == {1: False, 9: True}
    assert kept(first, "monday") == once
