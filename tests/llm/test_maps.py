"""Packing, licence scan, decontamination: operators that need no shuffle."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadforge.llm import decontamination, licenses, packing

from .conftest import ODD, prose

TEXTS = [(50, "Don't stop; I'LL <|endoftext|> x<|startoftext|>y, 12 ４５…!!"), (51, "é İstanbul ǅ ﬁ naïve/über.cool"),
         (52, prose(3, 6000)), (53, "!" * 9000), (54, "a.b,c;d " * 50)]


def test_pieces_hold_every_id_once(docs_of):
    rows = [*ODD, *TEXTS]
    pieces = [r.asDict() for r in packing.pack(docs_of(rows)).collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    for i, copies in texts.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == sum(map(len, copies))
        for p in own:
            ids = next(c for c in copies if len(c) == p["doc_tokens"])[p["start"]:p["start"] + p["length"]]
            assert len(ids) == p["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == p["ids_crc32"]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(p["length"] for p in pieces)
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in used) < 0.05 * total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, capacity = int(rng.integers(2, 40)), 8
        at = np.unique(np.concatenate([[0, n], np.arange(0, n, 5), rng.integers(0, n, 6)]))
        cost = rng.integers(0, 4, len(at))

        def pad(k):
            return 0 if k & (k - 1) == 0 else capacity - k

        best = {0: 0}
        for j, b in enumerate(at.tolist()):
            if j:
                best[b] = min(best[a] + pad(b - a) + int(cost[j]) for a in best if b - a <= capacity)
        cuts = [0, *packing.best_cuts(at, cost, capacity)]
        assert sum(pad(b - a) + int(cost[np.flatnonzero(at == b)[0]]) for a, b in zip(cuts, cuts[1:])) == best[n]


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id bigint, text string")
    assert packing.pack(empty).count() == licenses.scan_licences(empty).count() == decontamination.leaks(empty, bench).count() == 0
    assert decontamination.clean(empty, bench).columns == empty.columns


def brute_licence(text):
    ws = licenses.split_words(text or "")
    places = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_places_match_brute_force(docs_of):
    rows = [*ODD, (60, "GNU General-Public License, gnu general public license v3; the MIT licence. MIT License"),
            (61, "apache license apache license CC-BY cc by"), (62, prose(9, 3000) + " CC BY " + prose(8, 10)),
            (63, "gnu general public gnu general public license")]
    texts = dict(rows)
    for r in licenses.scan_licences(docs_of(rows)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licence(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_changed_notice_is_chained(docs_of):
    notice = dict(licenses.TEMPLATES[::-1])["mit"]
    full = next(t for label, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted"))
    changed = full.replace("including without limitation", "including, but WITHOUT any limitation")
    got = licenses.scan_licences(docs_of([(1, prose(1, 40) + " " + changed + " " + prose(2, 40)), (2, prose(3, 200)), (3, notice)])).collect()
    found = {r["doc_id"]: r for r in got}
    assert found[1]["labels"] == "mit" and found[1]["score"] > 0.8 and found[1]["spans"][0]["first_word"] == 40
    assert found[2]["labels"] == "" and found[2]["score"] == 0 and found[3]["labels"] == "mit"


def test_adjacent_notices_have_a_span_each(docs_of):
    full = next(t for label, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted"))
    changed = full.replace("including without limitation", "including, but WITHOUT any limitation")
    n, m = len(licenses.split_words(full)), len(licenses.split_words(changed))
    spdx = "SPDX-License-Identifier: MIT"
    rows = [(1, f"{full} {full}"), (2, f"{changed} {full} {changed}"), (3, f"{spdx} a.js {spdx} b.js {spdx}"), (4, f"{prose(1, 20)} {full}"),
            (5, f"{full} {full} " * 200)]
    got = {r["doc_id"]: [(s["first_word"], s["last_word"]) for s in r["spans"] if s["label"] == "mit"]
           for r in licenses.scan_licences(docs_of(rows)).collect()}
    assert got[1] == [(0, n - 1), (n, 2 * n - 1)]
    assert got[2] == [(0, m - 1), (m, m + n - 1), (m + n, 2 * m + n - 1)]
    assert got[3] == [(0, 3), (6, 9), (12, 15)]
    assert got[4] == [(20, 19 + n)] and got[5] == [(k * n, k * n + n - 1) for k in range(400)]


def test_hidden_chains_are_found():
    scanner = licenses.Scanner([("x", " ".join(f"w{i}" for i in range(20)))])
    # a copy in two parts, then another from word 7 on, whose parts could also follow the first part of the first
    anchors = [(0, 0, 0, 10), (0, 12, 10, 10), (0, 24, 7, 6), (0, 31, 13, 7)]
    assert [(f, e) for _, f, e, _ in scanner.chain(anchors)] == [(0, 21), (24, 37)]


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        templates = [rng.integers(0, 3, rng.integers(1, 8)).tolist() for _ in range(3)]
        automaton = licenses.SuffixAutomaton()
        for k, t in enumerate(templates):
            automaton.add(k, t)
        automaton.finish()
        text = rng.integers(0, 4, 30).tolist()
        for i, (state, n) in enumerate(automaton.statistics(text)):
            best = max(m for m in range(i + 2) if m == 0 or any(text[i + 1 - m:i + 1] == t[a:a + m] for t in templates for a in range(len(t))))
            assert n == best
            if n:
                places = {(k, e) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n:e] == text[i + 1 - n:i + 1]}
                assert {p for p in automaton.ends[state] if p[1] >= n} >= places


def items(spark):
    rows = [(k, " ".join(f"q{k}w{j}" for j in range(20)) + ". " + " ".join(f"a{k}w{j}" for j in range(8)) + ".") for k in range(12)]
    return rows, spark.createDataFrame([*rows, (90, None), (91, ""), (92, "too short"), (3, rows[3][1])], "item_id bigint, text string")


def test_leaks_match_planted_ones(spark, docs_of):
    rows, bench = items(spark)
    docs = docs_of([*ODD, (1000, prose(1, 300) + " " + rows[3][1].upper().replace(".", " !") + " " + prose(2, 300)),
                    (1001, rows[5][1] + " " + rows[6][1]), (1002, rows[7][1].split(".")[0]), (1003, prose(4, 5000)),
                    (1004, prose(5, 57) + " " + rows[8][1].replace("q8w3", "other"))])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect())
    assert got == [(1000, 3), (1000, 3), (1001, 5), (1001, 6)] or got == [(1000, 3), (1000, 3), (1001, 5), (1001, 6), (1004, 8)]
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns
    assert {1000, 1001}.isdisjoint({r["doc_id"] for r in left.collect()}) and left.filter(F.col("doc_id").isin(1002, 1003)).count() == 2


def test_short_items_match_as_runs_of_words(spark, docs_of):
    bench = spark.createDataFrame(
        [(1, "Who wrote Kestrel? Ada Quill."), (2, "what colour is zinc"), (3, "Xyzzyish!"), (4, "..."), (5, " ".join(f"q{j}" for j in range(30)))],
        "item_id bigint, text string")
    docs = docs_of([(10, prose(1, 200) + " who wrote KESTREL ada quill " + prose(2, 90)), (11, "Who wrote Kestrel? Not Ada Quill."), (12, "What colour is"),
                    (13, "zinc"), (14, "is zinc what colour is zinc"), (15, "xyzzyish"), (None, "Xyzzyish xyzzyish"), (16, None), (17, "")])
    got = sorted((r["doc_id"] or 0, r["item_id"], r["score"], r["first_word"]) for r in decontamination.leaks(docs, bench).collect())
    assert got == [(0, 3, 1.0, 0), (10, 1, 1.0, 200), (14, 2, 1.0, 2), (15, 3, 1.0, 0)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, bench).collect()) == [11, 12, 13, 16, 17]
    only = decontamination.leaks(docs, bench.filter("item_id = 2"))
    assert [r["doc_id"] for r in only.collect()] == [14]


def test_shards_find_the_same(spark, docs_of):
    rows, bench = items(spark)
    docs = docs_of([(k, prose(k, 80) + " " + t) for k, t in rows])
    assert sum(1 for _ in decontamination.indexes(bench, shard_bytes=400)) > 3
    one, many = (sorted(map(tuple, decontamination.leaks(docs, bench, shard_bytes=n).collect())) for n in (1 << 24, 400))
    assert {r[:2] for r in one} == {(k, k) for k, _ in rows}
    assert one == many


def test_shards_score_by_the_statistics_of_all_items(spark):
    """Every item's own impacts are the same in one shard and in many, and equal BM25 counted here by hand."""
    vocab = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(vocab, 8 + k % 20))) for k in range(120)] + [(500, "short one"), (501, None), (7, "w1 " * 40)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)

    def impacts(shard_bytes):
        got = {}
        for index in decontamination.indexes(bench, shard_bytes):
            for t, ks, xs in zip(index.terms.tolist(), index.items, index.impacts):
                got.update({(index.item_id[k], len(index.parts[k][0]), t): x for k, x in zip(ks, xs)})
        return got

    one, many = impacts(1 << 24), impacts(300)
    assert one.keys() == many.keys() and all(math.isclose(x, many[k], rel_tol=1e-12) for k, x in one.items())
    kept = [(i, t.split()) for i, t in rows if t and len(t.split()) >= 8]
    df = {w: sum(w in t for _, t in kept) for w in vocab}
    mean = sum(len(t) for _, t in kept) / len(kept)
    for i, t in kept[:40:7]:
        score = {w: math.log(1 + (len(kept) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2
                 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(t)}
        want = sorted(x / sum(score.values()) for x in score.values())
        got = sorted(x for (item, _, _), x in many.items() if item == i and i != 7)
        assert i == 7 or np.allclose(got, want, rtol=1e-9)


def test_wand_retrieves_all_above_the_threshold():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [(k, " ".join(rng.choice(vocab, 14))) for k in range(60)]
    index = decontamination.Index(texts, threshold=0.35)
    for _ in range(60):
        terms = np.unique(rng.integers(0, len(index.terms), 12)).tolist()
        scores = np.zeros(len(texts))
        for t in terms:
            for k, x in zip(index.items[t], index.impacts[t]):
                scores[k] += x
        want = {k for k in range(len(texts)) if scores[k] >= 0.35 + 1e-9}
        got = {k for k, _ in index.search(terms)}
        assert want <= got and all(scores[k] >= 0.35 - 1e-9 for k in got)
    assert re.match("w", vocab[0])
