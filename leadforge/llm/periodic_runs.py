"""Periodic run detection by a Kruskal pass over suffix classes.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal), at least ``max(min_length, 2 * q)`` long, that no neighbouring
word extends.

Per text, the suffixes that share their first words form classes. Classes are
united by decreasing LCP (longest common prefix, in words) with a union-find;
every class keeps its positions in order, and the smaller set goes into the
larger one. When two classes meet at LCP ``l``, positions ``i < j`` that become
neighbours share exactly ``l`` words, so ``[i, j + l)`` has period ``j - i``: a
seed if ``j - i <= l``. A seed whose words before ``i`` and ``j`` differ cannot grow
and is a run. Each run comes from one such seed, with its smallest period: were
there a position between its ends in the class, the two periods would have a
common divisor that is a smaller period, and under a smaller period a position
between would stand in the class already.

A run of ``min_length`` words has an LCP of ``min_length / 2`` at least, so the pass
stops there: suffixes whose first ``min_length / 2`` words stand once in their text
are in no class, and the texts of a batch are sorted together, as sequences of
such word groups, by prefix doubling on the repeated ones alone. Words are
compared exactly.

Result, one row per row of ``docs``: ``doc_id, n_words, runs`` (start, length,
period, by start, then period) and ``collapsed``: the words no run contains after
its first period, joined by one space.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null counts as empty, an empty text has
no run and an empty ``collapsed``; ids are handed through, repeated or null;
repeated rows fare alike; an empty table gives an empty result; other columns
are not read. A text is one task's work: its memory grows with its words times
the logarithm of its longest repeat.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, text_of
from .text import buffers, chunks, mix

MIN_LENGTH = 12
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RESULT = "doc_id {id}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of the words of all rows; a row's border ends a word."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = IS_SPACE[data]
    begins = ~space[1:-1] & space[:-2]
    ends = ~space[1:-1] & space[2:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = ~space[first + 1]
    ends[first[1:] - 1] = ~space[first[1:]]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words."""
    if not len(start):
        return np.zeros(0, dtype=np.int32)
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
    return words.dictionary_encode().indices.to_numpy()


def _group_heads(new: np.ndarray) -> np.ndarray:
    """For each element the index of the last true one up to it; the first counts as true."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def gram_ranks(ids: np.ndarray, row_first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every place, places in a class by rank): places share a rank if their next ``size`` words are equal
    and stand in the same row; a place with fewer words left has a rank of its own."""
    n = len(ids)
    row = np.repeat(np.arange(len(row_first) - 1), np.diff(row_first))
    at = np.flatnonzero(row_first[row + 1] - np.arange(n) >= size)
    value = mix(row[at].astype(np.uint64))
    for k in range(size):
        value = mix(value ^ ids[at + k].astype(np.uint64))
    by_value = np.argsort(value)
    order, value = at[by_value], value[by_value]

    def differ() -> np.ndarray:
        a, b = order[:-1], order[1:]
        out = row[a] != row[b]
        for k in range(size):
            out |= ids[a + k] != ids[b + k]
        return np.concatenate([[True], out])

    new = np.concatenate([[True], value[1:] != value[:-1]])
    alike = np.flatnonzero(~new)
    a, b = order[alike - 1], order[alike]
    same = row[a] == row[b]
    for k in range(size):
        same &= ids[a + k] == ids[b + k]
    if not same.all():  # different groups of words with one hash
        order = at[np.lexsort([ids[at + k] for k in range(size)] + [row[at]])]
        new = differ()
    rank = len(at) + np.arange(n + 1, dtype=np.int64)  # one more: the place behind the last word
    if not len(at):
        return rank, order
    rank[order] = _group_heads(new)
    return rank, order[_shared(new)]


def _shared(new: np.ndarray) -> np.ndarray:
    """Whether an element's group, begun by each true ``new``, has more than one element."""
    return ~(new & np.concatenate([new[1:], [True]]))


def suffix_order(rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, LCP with the place before in ranked symbols, 0 at a new class)."""
    levels, width, active = [rank], 1, places
    while len(active):
        key = (rank[active] << 32) | rank[active + width]
        by_key = np.argsort(key)
        active, key = active[by_key], key[by_key]
        old = rank[active]
        index = np.arange(len(active))
        place = old + index - _group_heads(np.concatenate([[True], old[1:] != old[:-1]]))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[active] = place[_group_heads(new)]
        active = active[_shared(new)]
        levels.append(rank)
        width *= 2
    order = places[np.argsort(rank[places])]
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(order), dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i, j = i + step, j + step
        lcp[1:] += step
    return order, lcp


def unite(order: np.ndarray, lcp: np.ndarray, reach: int = 0) -> list[tuple[int, int, int]]:
    """(i, j, l) for all places that become neighbours in a class at LCP ``l`` with ``j - i <= l + reach``.

    Neighbours in ``order`` are united by decreasing LCP, down to 1.
    """
    parent = list(range(len(order)))
    members = [[p] for p in order.tolist()]
    found = []
    links = np.flatnonzero(lcp > 0)
    links = links[np.argsort(-lcp[links], kind="stable")]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for at, shared in zip(links.tolist(), (lcp[links] + reach).tolist()):
        x, y = find(at - 1), find(at)
        large, small = members[x], members[y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y], members[y] = x, None
        before = -1  # the last place of the smaller set so far
        places = []
        for p in small:
            k = bisect_left(large, p)
            places.append(k)
            if k and large[k - 1] > before and p - large[k - 1] <= shared:
                found.append((large[k - 1], p, shared))
            before = p
        for p, after, k in zip(small, [*small[1:], None], places):
            if k < len(large) and (after is None or large[k] < after) and large[k] - p <= shared:
                found.append((p, large[k], shared))
        if len(small) * 16 < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()  # two ascending stretches: one merge
    return found


def find_runs(ids: np.ndarray, row_first: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(first word, length, period) of all runs of all rows, words numbered over the batch, by start, then period."""
    size = max(1, -(-min_length // 2))
    rank, places = gram_ranks(ids, row_first, size)
    if not len(places):
        return np.zeros((0, 3), dtype=np.int64)
    seeds = np.array(unite(*suffix_order(rank, places), reach=size - 1), dtype=np.int64).reshape(-1, 3)
    i, j, shared = seeds.T
    begins = np.zeros(len(ids) + 1, dtype=bool)
    begins[row_first] = True
    whole = (begins[i] | (ids[i - 1] != ids[j - 1])) & (shared + j - i >= min_length)
    i, j, shared = seeds[whole].T
    runs = np.stack([i, shared + j - i, j - i], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row_first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Per row its kept words, joined by one space."""
    at = np.flatnonzero(keep)
    kept_first = np.searchsorted(at, row_first)
    begin, stop = start[at], end[at]
    lead = np.ones(len(at), dtype=bool)                   # a space stands before all but a row's first word
    lead[kept_first[:-1][kept_first[:-1] < kept_first[1:]]] = False
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    edge[begin] += 1
    np.add.at(edge, stop, -1)
    inside = np.cumsum(edge[:-1]) > 0
    out = data.copy()
    out[begin[lead] - 1] = 0x20
    inside[begin[lead] - 1] = True
    sizes = np.concatenate([[0], np.cumsum(stop - begin + lead)])
    offsets = sizes[kept_first].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(row_first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out[inside])])


def _runs(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            start, end, row_first = space_words(data, offsets)
            runs = find_runs(word_ids(data, start, end), row_first, min_length)
            texts = joined_words(data, start, end, row_first, kept_words(len(start), runs))
            row = np.searchsorted(row_first, runs[:, 0], "right") - 1
            bounds = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            fields = [pa.array(runs[:, 0] - row_first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(offsets) - 1), pa.array(np.diff(row_first)),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, fields=list(RUN))),
                 texts.cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``; see the module text."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", text_of(docs).alias("text"))
    return narrow.mapInArrow(lambda batches: _runs(batches, min_length), RESULT.format(id=id_type))


def longest(runs: Column | str) -> Column:
    """The run of greatest length (ties: smallest start, then period) as a struct, null without a run."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    best = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("negative"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(
        best["start"].alias("start"), (-best["negative"]).alias("length"), best["period"].alias("period")))


def run_lines(runs: Column | str) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the stated repetition: in a tenth of the texts, chosen by the id's checksum, the words
    from one place on go round in a period. A null id is not chosen."""
    bounded_batches(docs.sparkSession)
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    turn = F.when(h % 10 == 0, F.floor(h / 10))
    narrow = docs.select("doc_id", text_of(docs).alias("text"), turn.cast("bigint").alias("turn"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_repeated, f"doc_id {id_type}, text string")


_WORD = re.compile("[^\x20\x09-\x0D]+")


def repeated(text: str, turn: int) -> str:
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return text
    a = turn % n
    period = 1 + (n - a) // (3 + turn % 8)
    return " ".join(words[:a] + (words[a:a + period] * (-(-(n - a) // period)))[:n - a])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, turn = batch.column(1), batch.column(2)
        chosen = pc.is_valid(turn)
        new = [repeated(t, g) for t, g in zip(text.filter(chosen).to_pylist(), turn.filter(chosen).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.replace_with_mask(text, chosen, pa.array(new, text.type))], names=["doc_id", "text"])
