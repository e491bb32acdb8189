"""Order-preserving packing of token streams by dynamic programming.

Each input partition is one stream: its documents in order, each tokenised
whole and closed with an end id. A stream is cut into windows of at most
``capacity`` tokens; a window becomes one sequence and is padded to
``capacity`` unless its length is a power of two. The cuts minimise

    padding + penalty of each cut (0 at a document's end, ``SENTENCE_COST``
    at a sentence's end, ``HARD_COST`` inside a sentence)

over candidate cuts. With ``f(j)`` the least cost of the stream up to candidate
``j`` at token ``b[j]``, ``f(j) = cost(j) + capacity - b[j] + min(f(i) + b[i])``
over the window ``b[j] - b[i] <= capacity``: the minimum comes from a monotone
queue in constant time per candidate. Transitions of a power-of-two length cost
no padding; they are found for all candidates at once.

The stream is solved a bounded number of tokens at a time: all windows but the
last are final, the last window's tokens are carried on. What is left at the
end of a stream is split into powers of two. Nothing is shuffled.

Token ids come from the public tokenizer. It splits a text at white space and
between a letter and a sign before it looks at vocabulary, so a text's ids are
those of its parts one after another; each distinct part is encoded once per
worker and looked up afterwards, a plain word by the vocabulary model alone.

Defined cases: a null or empty text is one piece holding the end id alone; a
text longer than ``capacity`` is cut into several pieces; repeated rows are
packed again each; a null id is kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tables import bounded_batches, text_of
from .text import LOWER, buffers, chunks, hash_spans

CAPACITY = 4096
END_ID = 2
SENTENCE_COST = 24
HARD_COST = 96
HARD_STEP = 64          # candidates inside stretches without a sentence's end
BUFFER_TOKENS = 1 << 20  # tokens solved at once
CACHED_PARTS = 600_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: signs that never belong to a special token or a contraction
SIGN = np.zeros(256, dtype=bool)
SIGN[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class PartTokenizer:
    """Token ids of whole texts, encoding each distinct blank-separated part once."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_sentence[ends] = True
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in printable]
        self.alphabet = {x: 256 + i for i, x in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _ids(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        other = []
        for part in parts:
            if PLAIN_WORD.fullmatch(part):
                word = part.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.alphabet)
                out.append([t.id for t in self.tokenizer.model.tokenize(word)])
            else:
                other.append((len(out), part))
                out.append(None)
        encoded = self.tokenizer.encode_batch_fast([p for _, p in other], add_special_tokens=False)
        for (i, _), e in zip(other, encoded):
            out[i] = e.ids
        return out

    def _learn(self, keys: list[int], parts: list[str]) -> None:
        encoded = self._ids(parts)
        count = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        total, n = int(count.sum()), len(self.place)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(count) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=total)
        self.first[n:n + len(count)] = self.used + np.cumsum(count) - count
        self.count[n:n + len(count)] = count
        self.place.update(zip(keys, range(n, n + len(count))))
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of texts given as bytes and offsets: row ``r`` has ``ids[first[r]:first[r + 1]]``."""
        if len(self.place) > CACHED_PARTS:
            self.clear()
        n = len(data)
        solid = ~SPACE[data]
        begins, ends = solid.copy(), solid.copy()
        if n:
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            # special tokens are matched as they are written, before anything else
            if not np.any((data[:-1] == ord("<")) & (data[1:] == ord("|"))):
                data = LOWER[data]
                letter, sign = LETTER[data], SIGN[data]
                between = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
                begins[1:] |= between
                ends[:-1] |= between
            firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[firsts] = solid[firsts]
            ends[firsts[1:] - 1] = solid[firsts[1:] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        keys, where, inverse = np.unique(hash_spans(padded, start, end), return_index=True, return_inverse=True)
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.place]
        if new:
            at = where[new]
            self._learn([listed[i] for i in new],
                        [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[at], end[at])])
        place = np.fromiter((self.place[k] for k in listed), dtype=np.int64, count=len(listed))[inverse]
        count = self.count[place]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[place] - before[:-1], count) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, offsets, "left")]


def candidates(ids: np.ndarray, doc_end: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of the cuts worth trying; 0 and the end are among them.

    ``doc_end`` lists the positions after each document's last token.
    """
    n = len(ids)
    cost = np.full(n + 1, -1, dtype=np.int64)
    cost[1:][ends_sentence[ids]] = SENTENCE_COST
    cost[doc_end] = 0
    cost[0] = 0
    if cost[n] < 0:
        cost[n] = HARD_COST
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > HARD_STEP)
    if len(wide):
        steps = [np.arange(at[w] + HARD_STEP, at[w + 1], HARD_STEP) for w in wide]
        cost[np.concatenate(steps)] = HARD_COST
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The positions of the cuts of the cheapest windows from the first to the last candidate."""
    m = len(at)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= capacity:
        source = np.searchsorted(at, at - size)
        ok = np.flatnonzero((source < m) & (at[np.minimum(source, m - 1)] == at - size))
        for j, i in zip(ok.tolist(), source[ok].tolist()):
            exact.setdefault(j, []).append(i)
        size *= 2
    b, c = at.tolist(), cost.tolist()
    total, back = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(b[0], 0)])  # (f(i) + b[i], i), ascending in both
    for j in range(1, m):
        here = b[j]
        while here - b[queue[0][1]] > capacity:
            queue.popleft()
        least, i = queue[0]
        best = least + capacity - here
        for x in exact.get(j, ()):
            if total[x] < best:
                best, i = total[x], x
        total[j], back[j] = best + c[j], i
        key = total[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], m - 1
    while j:
        cuts.append(b[j])
        j = back[j]
    return cuts[::-1]


def powers(length: int, capacity: int) -> list[int]:
    """Lengths that sum up to ``length``: full windows, then powers of two."""
    parts = [capacity] * (length // capacity)
    rest = length % capacity
    return parts + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Packer:
    """One stream: takes documents' ids, gives pieces."""

    def __init__(self, ends_sentence: np.ndarray, capacity: int, first_sequence: int):
        self.ends_sentence, self.capacity, self.sequence = ends_sentence, capacity, first_sequence
        self.ids = np.zeros(0, dtype=np.uint32)
        self.base = 0            # stream position of ids[0]
        self.docs: list = []     # ids of the documents that reach into the buffer
        self.doc_start = np.zeros(0, dtype=np.int64)  # their stream positions
        self.doc_length = np.zeros(0, dtype=np.int64)

    def add(self, docs: list, ids: np.ndarray, first: np.ndarray) -> None:
        self.docs += docs
        end = self.base + len(self.ids)
        self.doc_start = np.concatenate([self.doc_start, end + first[:-1]])
        self.doc_length = np.concatenate([self.doc_length, np.diff(first)])
        self.ids = np.concatenate([self.ids, ids])

    def cut(self, last: bool) -> dict[str, list]:
        """Pieces of all windows that are final."""
        n = len(self.ids)
        ends = self.doc_start + self.doc_length - self.base
        at, cost = candidates(self.ids, ends[(ends > 0) & (ends <= n)], self.ends_sentence)
        cuts = best_cuts(at, cost, self.capacity)
        if not last:
            cuts = cuts[:-1]
        elif cuts:
            before = cuts[-2] if len(cuts) > 1 else 0
            tail = powers(cuts[-1] - before, self.capacity)
            cuts = cuts[:-1] + (before + np.cumsum(tail)).tolist()
        return self._pieces(np.array([0, *cuts], dtype=np.int64))

    def _pieces(self, window: np.ndarray) -> dict[str, list]:
        stop = int(window[-1])
        inside = self.doc_start - self.base
        point = np.unique(np.concatenate([window, inside[(inside > 0) & (inside < stop)]]))
        begin, length = point[:-1], np.diff(point)
        doc = np.searchsorted(inside, begin, "right") - 1
        place = np.searchsorted(window, begin, "right") - 1
        out = {
            "doc_id": [self.docs[d] for d in doc], "start": begin - inside[doc], "length": length,
            "ids_crc32": [zlib.crc32(self.ids[s:s + k].astype("<u4").tobytes()) for s, k in zip(begin.tolist(), length.tolist())],
            "doc_tokens": self.doc_length[doc], "sequence_id": self.sequence + place, "offset": begin - window[place],
        }
        self.sequence += len(window) - 1
        keep = int(np.searchsorted(inside + self.doc_length, stop, "right"))
        self.docs, self.doc_start, self.doc_length = self.docs[keep:], self.doc_start[keep:], self.doc_length[keep:]
        self.ids, self.base = self.ids[stop:], self.base + stop
        return out


_TOKENIZERS: dict[str | None, PartTokenizer] = {}


def tokenizer_of(path: str | None) -> PartTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PartTokenizer(path)
    return _TOKENIZERS[path]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each row's ids."""
    return np.insert(ids, first[1:], end_id).astype(np.uint32), first + np.arange(len(first))


def _pack(path: str | None, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = pa.schema([(c.strip().split()[0], pa.int64()) for c in SCHEMA.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        packer = Packer(tokenizer.ends_sentence, capacity, TaskContext.get().partitionId() << 33)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo, data, offsets in chunks(*buffers(batch.column(1))):
                ids, first = with_end(*tokenizer.encode(data, offsets), end_id)
                packer.add(docs[lo:lo + len(offsets) - 1], ids, first)
                if len(packer.ids) >= BUFFER_TOKENS:
                    yield pa.RecordBatch.from_pydict(packer.cut(last=False), schema=fields)
        if len(packer.ids):
            yield pa.RecordBatch.from_pydict(packer.cut(last=True), schema=fields)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece; see the module text. ``capacity`` is a power of two."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return narrow.mapInArrow(_pack(tokenizer_path, capacity, end_id), SCHEMA)
