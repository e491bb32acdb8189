"""Benchmark decontamination: a BM25 index of the test items, asked by every passage.

The test items are indexed (BM25, impacts divided by the item's score for its
own words, so that a score is the share of an item that a passage holds). Every
text is cut into overlapping passages, wide enough that any place an item could
stand lies within one of them, and each passage is a query against the index
with one threshold:

1. a passage whose terms' largest impacts do not sum to the threshold cannot
   reach any item (the pivot condition of WAND), nor can one whose terms' maxima
   within each block of neighbouring items do not; both are decided for all
   passages of a batch at once;
2. the others run block-max WAND: cursors over the postings of their terms, a
   pivot from the terms' maxima, a second bound from the maxima of the blocks
   the pivot falls in, and whole blocks skipped where that bound fails. All
   items above the threshold are retrieved;
3. each retrieved item is verified: shares of the question's and the answer's
   five-word shingles that the passage holds, 0.8 or more of both. The answer
   is an item's last sentence (the last third of a single one).

Items of fewer than ``MIN_WORDS`` words are too short for shingles of both parts.
They are looked up by hash: a text holds one where all its words stand in it in
a row (score and overlaps are 1).

The index is broadcast in shards of about ``SHARD_BYTES`` bytes of item text, so
its size is bounded whatever the number of items. Counts, mean length, longest
item and document frequencies are taken once over all items (``Statistics``), so
an item has the same passages and scores in whichever shard it stands. Texts are
read once per shard and never shuffled.

Defined cases: null and empty texts or items hold no passage and are in no
pair, nor do items without a word; repeated rows and items give a row each; a null id is kept; an empty table gives an empty
result; other columns are not read (``clean`` hands them through).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bounded_batches, materialise, text_of
from .text import buffers, chunks, mix, shingle_hashes, word_hashes, words

K1, B = 1.2, 0.75
THRESHOLD = 0.6          # share of an item's own score
OVERLAP = 0.8
SHINGLE = 5
MIN_WORDS = 8            # shorter items are matched as runs of words
BLOCK = 8                # postings under one block maximum
GROUPS = 48              # blocks of neighbouring items in the bound of whole batches
AT_ONCE = 4096           # passages bounded at once
STRIDE = 64
SHARD_BYTES = 16 << 20
SENTENCE = re.compile(r"(?<=[.?!])\s+")
#: ``first_word``: where the passage begins, or the first run of a short item
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(words(data, np.array([0, len(data)])))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    value, _ = shingle_hashes(hashes, np.array([0, len(hashes)]), SHINGLE)
    return np.unique(value)


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the two parts."""
    parts = SENTENCE.split(text.strip())
    whole = hashes_of(text)
    cut = len(hashes_of(" ".join(parts[:-1]))) if len(parts) > 1 else len(whole) - len(whole) // 3
    cut = min(max(cut, 1), len(whole) - 1)
    return whole[:cut], whole[cut:]


@dataclass
class Statistics:
    """Of all items of ``MIN_WORDS`` words or more: number, words, longest; items of each term (at least the shard's)."""

    items: int
    words: int
    longest: int
    frequency: dict[int, int]

    @classmethod
    def of(cls, tokens: list[list[int]]) -> Statistics:
        sizes = [len(t) for t in tokens]
        return cls(len(tokens), sum(sizes), max(sizes, default=0), Counter(t for ts in tokens for t in set(ts)))


class Index:
    """BM25 postings with the maxima of terms and of blocks of postings.

    ``statistics`` are those of the whole collection that ``items`` are a part of; without them, of ``items``.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, statistics: Statistics | None = None):
        self.threshold = threshold
        known = [(i, t, hashes_of(t)) for i, t in items if t]
        kept = [(i, t) for i, t, h in known if len(h) >= MIN_WORDS]
        short = [(i, h) for i, _, h in known if 0 < len(h) < MIN_WORDS]
        self.item_id = [i for i, _ in kept] + [i for i, _ in short]  # short items after the indexed ones
        tokens = [h.tolist() for _, _, h in known if len(h) >= MIN_WORDS]
        # by number of words: sorted run hashes and the items of each
        self.runs: list[tuple[int, np.ndarray, list[list[int]]]] = []
        for size in range(1, MIN_WORDS):
            by_run: dict[int, list[int]] = defaultdict(list)
            for k, (_, h) in enumerate(short, len(kept)):
                if len(h) == size:
                    by_run[int(shingle_hashes(h, np.array([0, size]), size)[0][0])].append(k)
            if by_run:
                self.runs.append((size, np.array(sorted(by_run), dtype=np.uint64), [by_run[r] for r in sorted(by_run)]))
        self.parts = [tuple(shingles_of(p) for p in question_and_answer(t)) for _, t in kept]
        stats = statistics or Statistics.of(tokens)
        self.longest = stats.longest if tokens else 0
        average = stats.words / max(stats.items, 1)
        idf = {t: math.log(1 + (stats.items - n + 0.5) / (n + 0.5)) for t, n in stats.frequency.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, ts in enumerate(tokens):
            norm = K1 * (1 - B + B * len(ts) / average)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(ts).items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((k, x / own))
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        ordered = [postings[t] for t in self.terms.tolist()]
        self.items = [[k for k, _ in p] for p in ordered]
        self.impacts = [[x for _, x in p] for p in ordered]
        self.block_max = [[max(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts] + [0.0])
        # maxima by block of neighbouring items, in GROUPS blocks at most
        width = max(1, -(-len(tokens) // GROUPS))
        self.group_max = np.zeros((len(self.terms), max(1, -(-len(tokens) // width))), dtype=np.float32)
        for t, (ks, xs) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.group_max[t], np.array(ks) // width, np.array(xs, dtype=np.float32))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word hash, or the number of terms."""
        if not len(self.terms):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) whose score for the distinct ``terms`` reaches the threshold: block-max WAND."""
        cursors = [[self.items[t][0], 0, t] for t in terms]  # (item, place in the postings, term)
        found = []
        need = self.threshold
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that the pivot item would stand in
            bound, beyond = 0.0, math.inf
            for _, place, t in cursors[:pivot + 1]:
                block = bisect_left(self.items[t], item, place) // BLOCK
                if block < len(self.block_max[t]):
                    bound += self.block_max[t][block]
                    last = min((block + 1) * BLOCK, len(self.items[t])) - 1
                    beyond = min(beyond, self.items[t][last] + 1)
            if bound >= need:
                if cursors[0][0] == item:
                    score = sum(self.impacts[t][p] for i, p, t in cursors[:pivot + 1])
                    if score >= need:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                target = max(beyond, item + 1)
            moved = []
            for c in cursors[:pivot + 1]:
                if c[0] < target:
                    place = bisect_left(self.items[c[2]], target, c[1])
                    if place == len(self.items[c[2]]):
                        continue
                    c = [self.items[c[2]][place], place, c[2]]
                moved.append(c)
            cursors = moved + cursors[pivot + 1:]

    def _reaching(self, numbers: np.ndarray, begin: np.ndarray, stop: np.ndarray, likely: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(passage, distinct terms) of passages whose bound in some block of items reaches the threshold."""
        size = len(self.terms)
        for lo in range(0, len(likely), AT_ONCE):
            part = likely[lo:lo + AT_ONCE]
            n = stop[part] - begin[part]
            which = np.repeat(np.arange(len(part)), n)
            term = numbers[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair = np.unique((which * size + term)[term < size])
            which, term = pair // size, pair % size
            first = np.flatnonzero(np.diff(which, prepend=-1))
            if not len(first):
                continue
            bound = np.add.reduceat(self.group_max[term], first, axis=0).max(axis=1)
            last = np.append(first[1:], len(which))
            for i in np.flatnonzero(bound >= self.threshold - 1e-4).tolist():
                yield int(part[which[first[i]]]), term[first[i]:last[i]].tolist()

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(row, item, score, question overlap, answer overlap, first word) of verified passages, best per item."""
        w = words(data, offsets)
        if not len(w.start):
            return
        hashes = word_hashes(w)
        best = self._short_items(hashes, w.row_first)
        if self.longest:
            best |= self._passages(hashes, w.row_first)
        for (r, item), found in sorted(best.items()):
            yield r, item, *found

    def _short_items(self, hashes: np.ndarray, row_first: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(row, item) of short items whose words stand in a row, with the first place."""
        best: dict[tuple[int, int], tuple] = {}
        row = np.repeat(np.arange(len(row_first) - 1), np.diff(row_first)) if self.runs else None
        for size, known, items in self.runs:
            at = np.flatnonzero(np.arange(len(hashes)) + size <= row_first[row + 1])
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(size):
                value = mix(value ^ hashes[at + k])
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            for i in np.flatnonzero(known[place] == value).tolist():
                r = int(row[at[i]])
                for item in items[place[i]]:
                    best.setdefault((r, item), (1.0, 1.0, 1.0, int(at[i] - row_first[r])))
        return best

    def _passages(self, hashes: np.ndarray, row_first: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(row, item) of indexed items, with the best verified passage."""
        numbers = self.numbers(hashes)
        count = np.diff(row_first)
        passages = np.where(count > 0, np.maximum(1, -(-(count - self.longest) // STRIDE)), 0)
        row = np.repeat(np.arange(len(count)), passages)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages)
        begin = row_first[row] + nth * STRIDE
        stop = np.minimum(begin + STRIDE + self.longest, row_first[row + 1])
        total = np.concatenate([[0.0], np.cumsum(self.most[numbers])])
        likely = np.flatnonzero(total[stop] - total[begin] >= self.threshold - 1e-9)
        best: dict[tuple[int, int], tuple] = {}
        for p, terms in self._reaching(numbers, begin, stop, likely):
            b, s = int(begin[p]), int(stop[p])
            hits = self.search(terms)
            if not hits:
                continue
            held = shingles_of(hashes[b:s])
            for item, score in hits:
                question, answer = (float(np.isin(x, held).mean()) if len(x) else 1.0 for x in self.parts[item])
                # a part of fewer words than a shingle has one shingle, of all its words
                answer = max(answer, _short_part(self.parts[item][1], hashes[b:s]))
                question = max(question, _short_part(self.parts[item][0], hashes[b:s]))
                if question >= OVERLAP and answer >= OVERLAP:
                    r = int(row[p])
                    new = (score, question, answer, b - int(row_first[r]))
                    if (r, item) not in best or new[:3] > best[r, item][:3]:
                        best[r, item] = new
        return best


def _short_part(shingles: np.ndarray, hashes: np.ndarray) -> float:
    """1.0 if a single shingle stands in the passage as a run of fewer than ``SHINGLE`` words."""
    if len(shingles) != 1:
        return 0.0
    for size in range(1, SHINGLE):
        n = len(hashes) - size + 1
        if n <= 0:
            break
        edges = np.arange(n + 1) * size
        runs = np.lib.stride_tricks.sliding_window_view(hashes, size).reshape(-1)
        value, _ = shingle_hashes(np.ascontiguousarray(runs), edges, SHINGLE)
        if np.any(value == shingles[0]):
            return 1.0
    return 0.0


def _matched(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[lo + r], index.item_id[item], score, q, a, first)
                   for lo, data, offsets in chunks(*buffers(batch.column(1)))
                   for r, item, score, q, a, first in index.matches(data, offsets)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if 2 <= i <= 4 else pa.int64()) for i, c in enumerate(zip(*out))],
                    names=[c.strip().split()[0] for c in SCHEMA.split(",")])

    return run


def _flagged(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = np.zeros(batch.num_rows, dtype=bool)
            for lo, data, offsets in chunks(*buffers(batch.column(1))):
                for r, *_ in index.matches(data, offsets):
                    leaks[lo + r] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaks)], names=["row", "leaks"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, words, distinct terms) of each item of ``MIN_WORDS`` words or more."""
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            w = words(data, offsets)
            hashes, count = word_hashes(w).view(np.int64), np.diff(w.row_first)
            rows = np.flatnonzero(count >= MIN_WORDS)
            terms = [np.unique(hashes[w.row_first[r]:w.row_first[r + 1]]) for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lo + rows)), pa.array(count[rows], pa.int64()), pa.array(terms, pa.list_(pa.int64()))],
                names=["shard", "words", "terms"])


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, threshold: float = THRESHOLD) -> Iterator[Index]:
    """The items' index, in shards of about ``shard_bytes`` bytes of text; one shard is on the driver at a time.

    Statistics are counted by Spark over all items; a shard gets the frequencies of its own terms alone.
    """
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), text_of(benchmark).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    counted = materialise(items.select("shard", "text").mapInArrow(_item_terms, "shard bigint, words bigint, terms array<bigint>"), "item_terms")
    whole = counted.agg(F.count(F.lit(1)), *[F.coalesce(f("words"), F.lit(0)) for f in (F.sum, F.max)]).first()
    places = counted.select("shard", F.explode("terms").alias("term")).groupBy("term", "shard").agg(F.count(F.lit(1)).alias("n"))
    frequency = materialise(
        places.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shards")), "item_frequency")
    for k in range(shards):
        own = frequency.filter(F.array_contains("shards", F.lit(k).cast("bigint"))).select("term", "n")
        df = {r["term"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in own.toLocalIterator()}
        part = items.filter(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text")
        yield Index([(r["item_id"], r["text"]) for r in part.toLocalIterator()], threshold, Statistics(*whole, df))


def leaks(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document and test item it holds; see ``SCHEMA``."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    result = None
    for index in indexes(benchmark, shard_bytes):
        part = narrow.mapInArrow(_matched(index), SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    for index in indexes(benchmark):
        ready = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text_of(docs).alias("text"))
        schema = T.StructType([ready.schema["row"], T.StructField("leaks", T.BooleanType())])
        docs = ready.mapInArrow(_flagged(index), schema).filter(~F.col("leaks")).select("row.*")
    return docs
