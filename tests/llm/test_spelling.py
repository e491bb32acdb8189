"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leadforge.llm import fm_index, spelling
from leadforge.llm.queries import op13_spelling_variants

from .conftest import ODD, prose


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def all_pairs(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        form = min(near, key=lambda v: (-counts[v], v)) if near else None
        form = form if near and counts[form] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def counted(rows, drop_one_in=0):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if drop_one_in and i is not None and h % drop_one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def vocabulary(seed, size, letters="abcdé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(size)}
    return {w: rng.choice([1, 2, 3, 4, 8, 16, 40]) for w in sorted(words)}


def codes(words, alphabet):
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return np.array([alphabet.index(c) + 1 if c in alphabet else len(alphabet) + 1 for w in words for c in w], dtype=np.uint8), offsets


@pytest.mark.parametrize("letters", ["a", "ab", "abcd"])
def test_search_finds_words_with_one_error_in_either_half(letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(200)})
    asked = words + ["".join(rng.choice(letters + "z") for _ in range(rng.randint(2, 9))) for _ in range(40)]
    index = fm_index.Index(*codes(words, letters), len(letters) + 1)
    found = set()
    for right in (True, False):
        query, rank = fm_index.one_error(index, *codes(asked, letters), right)
        pairs = {(asked[q], words[r]) for q, r in zip(query.tolist(), rank.tolist())}
        assert all(v.startswith(w[:len(w) // 2]) if right else v.endswith(w[len(w) // 2:]) for w, v in pairs)
        found |= pairs
    assert found == {(w, v) for w in asked for v in words if one_edit(w, v)}


def test_both_intervals_of_a_pattern_stay_in_step():
    words = sorted(vocabulary(3, 80))
    letters, offsets = codes(words, "abcdé")
    index = fm_index.Index(letters, offsets, 6)
    text = "".join("$" + w for w in words)
    for pattern in ("$ab", "ca", "bé", "a$", "dd$", "cb$a"):
        symbols = ["$abcdé".index(c) for c in pattern]
        for middle in range(len(pattern) + 1):
            p = index.everything(1)
            for c in symbols[middle:]:
                p = index.extend_right(p, np.array([c]))
            for c in reversed(symbols[:middle]):
                p = index.extend_left(p, np.array([c]))
            count = sum((text + text).startswith(pattern, k) for k in range(len(text)))
            assert p.high[0] - p.low[0] == count
            if pattern[0] == "$" and count:
                firsts = [i for i, w in enumerate(words) if ("$" + w).startswith(pattern)]
                assert (p.low[0], p.high[0]) == (firsts[0], firsts[-1] + 1)


@pytest.mark.parametrize("block", [spelling.BLOCK_LETTERS, 150])
def test_variants_equal_all_pairs(spark, block):
    """With small blocks every bucket is searched block by block."""
    counts = vocabulary(5, 300) | {"aaaaa": 7, "aaaaaa": 14, "aaaaaaa": 28, "aaaaaaaa": 56}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling.spelling_variants(words, bucket_letters=2000, block_letters=block).collect()
    assert len(got) == len(counts)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == all_pairs(counts)


def test_query_equals_all_pairs(spark, docs_of, tmp_path):
    words = list(vocabulary(8, 150, "abcdéÀ÷"))
    rng = random.Random(4)
    rows = [*ODD, (7, prose(7, 3000)), (None, "Garden gArden garden 1garden2 gardén gardn gardeń " * 4)]
    rows += [(100 + i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=60))) for i in range(60)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_spelling_variants(spark, str(tmp_path)).collect()
    want = all_pairs(counted(rows, 97))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) and any(w not in words and f for w, (f, *_) in want.items())


def test_counts_without_dropped_letters(docs_of, empty):
    rows = [(1, "Ünder under UNDER ünder " * 3), (None, "under"), (2, None), (2, "x" * 70_000 + " " + "long " * 3)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs_of(rows)).collect()}
    assert got == {k: n for k, n in counted(rows).items()} and got["Ünder"] == 3
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
