"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leadforge.llm import periodic_runs as P
from leadforge.llm.queries import op12_periodic_runs
from leadforge.llm.text import CHUNK_BYTES, buffers

from .conftest import ODD, prose


def every_run(words, min_length=12):
    """All maximal stretches of every period, those with a smaller period left out."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            part = words[s:s + length]
            if i > s and length >= max(min_length, 2 * q) and all(
                    any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    keep = [True] * len(words)
    for s, length, q in runs:
        keep[s + q:s + length] = [False] * (length - q)
    return " ".join(w for w, k in zip(words, keep) if k)


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def looped(seed, head, period, n):
    words = prose(seed, head + period).split()
    return " ".join(words[:head] + (words[head:] * n)[:n])


CASES = [*ODD, (20, "a " * 40), (21, looped(1, 5, 4, 30)), (22, looped(2, 0, 9, 18)), (23, "a b " * 3 + "a b a b c " * 4),
         (24, " é  ñ\t" * 30), (25, "x\x00y " * 12), (26, ("a b c " * 5 + "d ") * 4), (27, "ab ab a bab " * 9)]


@pytest.mark.parametrize("min_length", [P.MIN_LENGTH, 5, 1])
def test_runs_equal_the_scan_of_every_period(min_length):
    rng = random.Random(min_length)
    for _ in range(120):
        rows = []
        for _ in range(4):
            n = rng.choice([0, 1, 7, 30, 80])
            words = [rng.choice("abcde"[:rng.choice([1, 2, 5])]) for _ in range(n)]
            if n > 10:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            rows.append(words)
        data, offsets = buffers(pa.array([" \n".join(w) for w in rows]))
        start, end, row_first = P.space_words(data, offsets)
        got = [[] for _ in rows]
        for s, length, q in P.find_runs(P.word_ids(data, start, end), row_first, min_length).tolist():
            r = int(np.searchsorted(row_first, s, "right")) - 1
            got[r].append((s - row_first[r], length, q))
        assert got == [every_run(w, min_length) for w in rows]


def test_classes_are_not_misled_by_equal_hashes(monkeypatch):
    monkeypatch.setattr(P, "mix", lambda x: x * np.uint64(0))
    data, offsets = buffers(pa.array([looped(1, 5, 4, 30), looped(3, 2, 6, 40)]))
    start, end, row_first = P.space_words(data, offsets)
    runs = P.find_runs(P.word_ids(data, start, end), row_first)
    assert runs.tolist() == [[5, 30, 4], [row_first[1] + 2, 40, 6]]


def test_operator_returns_runs_and_collapsed_text(docs_of):
    rows = CASES + [(30, looped(4, 50, 900, 2600)), (31, "word " * 40_000 + "end " + "x y " * (CHUNK_BYTES // 4))]
    got = P.periodic_runs(docs_of(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        words = split(texts[r["doc_id"]][0])
        runs = [tuple(x) for x in r["runs"]]
        if len(words) < 5000:
            assert runs == every_run(words)
        else:
            n = len(words)
            assert runs == [(0, 40_000, 1), (40_001, n - 40_001, 2)]
        assert (r["n_words"], r["collapsed"]) == (len(words), collapse(words, runs))


def test_odd_and_empty_tables(odd, empty):
    assert all(r["runs"] == [] for r in P.periodic_runs(odd).collect())
    assert P.periodic_runs(empty).count() == 0


def test_query_returns_the_stated_digests(spark, docs_of, tmp_path):
    rows = [(i, prose(i, 5 + 7 * i % 211)) for i in range(60)] + [*CASES, (None, looped(6, 3, 4, 20))]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        if [k for k, _ in rows].count(i) > 1:
            continue
        words, n = split(text), len(split(text))
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = every_run(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert tuple(got[i])[1:] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapse(words, runs).encode()).hexdigest()), i
    assert planted > 3
