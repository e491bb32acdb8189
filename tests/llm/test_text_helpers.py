import re

import numpy as np
import pyarrow as pa

from leadforge.llm.suffix_array import END, joint_suffix_array, suffix_array
from leadforge.llm.text import buffers, chunks, shingle_hashes, word_hashes, words

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["The quick-brown Fox", None, "", "éé 12ab", "...", "x" * 40 + " y", "a b c d e f"]


def test_words_match_the_pattern_per_row():
    data, offsets = buffers(pa.array(TEXTS))
    w = words(data, offsets)
    got = [[w.text(i) for i in range(a, b)] for a, b in zip(w.row_first[:-1], w.row_first[1:])]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in TEXTS]
    assert got == [WORD.findall(t) for t in lower]


def test_equal_words_have_equal_hashes_and_others_differ():
    w = words(*buffers(pa.array(["alpha beta ALPHA " + "z" * 30, "z" * 30 + " z" + "z" * 30])))
    h = word_hashes(w)
    assert h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 4


def test_shingles_of_short_and_long_rows():
    w = words(*buffers(pa.array(["a b", "", "a b c d e f", "a b c d e"])))
    value, row = shingle_hashes(word_hashes(w), w.row_first, 5)
    assert row.tolist() == [0, 2, 2, 3] and value[1] == value[3] != value[0]


def test_chunks_cover_all_rows():
    data, offsets = buffers(pa.array(["abc", "", "defgh", "i"]))
    parts = [(lo, bytes(d), o.tolist()) for lo, d, o in chunks(data, offsets, limit=4)]
    assert b"".join(d for _, d, _ in parts) == b"abcdefghi" and [p[0] for p in parts][0] == 0
    assert sum(len(o) - 1 for _, _, o in parts) == 4


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, k = rng.integers(0, 40), rng.integers(1, 6)
        s = [*rng.integers(1, k + 1, size=n).tolist(), 0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_joint_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(400):
        strings = [rng.integers(0, rng.integers(1, 5), size=rng.integers(0, 12)).tolist() for _ in range(rng.integers(0, 7))]
        places, at = [], 0
        for k, string in enumerate(strings):
            places += [(string[i:], k, at + i) for i in range(len(string))]
            at += len(string) + 1
        assert joint_suffix_array([x for string in strings for x in [*string, END]]) == [place for *_, place in sorted(places)]
