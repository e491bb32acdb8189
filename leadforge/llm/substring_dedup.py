"""Substring dedup by content-defined chunks.

A gear rolling hash runs over every byte of every text: the hash after a byte
depends on the last 16 bytes alone. A place is a candidate cut where the masked
hash is zero; it is a cut if no other candidate lies in the ``MIN_CHUNK`` bytes
before it, so cuts depend on nearby content only and an insertion shifts no cut
beyond its neighbourhood. Longer stretches are cut every ``MAX_CHUNK`` bytes.

Neighbouring chunks that together reach ``MIN_RUN`` bytes are a *window*: from
every chunk the fewest chunks onwards, and up to every chunk the fewest before
it. Windows are known by a 128-bit digest of their chunks' digests. The first
place of a window, by ``(doc_id, start)``, stays; all others are removed, and
what they cover together are the removed runs. A run of ``MIN_RUN`` bytes or more
that stands elsewhere chunk for chunk is covered by its own windows to both ends;
chunks that are known from different places only (chance repeats of a phrase or
a line) are in no repeated window and stay.

The digests are aggregated partially (a window that occurs in a third of all
rows costs one row per task). Only windows that a Bloom filter of the repeated
digests passes are shuffled again, to meet their first document, in a join of
two freshly shuffled sides that adaptive execution splits where a digest is hot;
and only texts with a run to remove are shuffled to meet their runs. Windows are
cut anew where they are needed, which costs less than keeping them.

Result, one row per row of ``docs``: ``doc_id, n_bytes, n_chunks, n_removed``
(bytes), ``n_spans`` and ``spans`` (maximal removed runs, start and length) and
``kept_sha256`` of the bytes that stay.

Defined cases: null counts as empty; an empty text has no chunk; rows that
repeat an id are one document, whose places are not earlier than themselves, so
repeated rows fare alike; a null id comes before all others; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .tables import bounded_batches, materialise, text_of
from .text import buffers, chunks, hash_spans, mix

WINDOW = 16                     # bytes the rolling hash depends on
MASK = np.uint16(0xF000)        # four of the top bits: one byte in 16 is a candidate
MIN_CHUNK = 8
MAX_CHUNK = 512
MIN_RUN = 100
FIRST_ID = -(1 << 63)           # stands for a null id
GEAR = np.random.default_rng(29).integers(0, 1 << 16, size=256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of ``GEAR[byte] << age`` over the last ``WINDOW`` bytes, by doubling."""
    h = GEAR[data]
    k = 1
    while k < WINDOW:
        older = h[:-k] << np.uint16(k)
        h[k:] += older
        k *= 2
    return h


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks, ascending; the end of every row that is not empty is among them."""
    at = np.flatnonzero((gear(data) & MASK) == 0) + 1
    # within WINDOW bytes of a row's start the hash still sees the row before
    row_start = offsets[np.searchsorted(offsets, at, "left") - 1]
    far = at - row_start >= WINDOW
    at, row_start = at[far], row_start[far]
    if len(at):
        keep = np.ones(len(at), dtype=bool)
        keep[1:] = (at[1:] - at[:-1] > MIN_CHUNK) | (row_start[1:] != row_start[:-1])
        at = at[keep]
    ends = np.union1d(at, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - starts) // MAX_CHUNK)
    if not len(ends) or pieces.max() == 1:
        return ends
    start = np.repeat(starts, pieces)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
    return np.minimum(start + nth * MAX_CHUNK, np.repeat(ends, pieces))


def chunk_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, digest high, digest low) of all chunks."""
    ends = cut_places(data, offsets)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    row = np.searchsorted(offsets, starts, "right") - 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    high, low = (hash_spans(padded, starts, ends, seed).view(np.int64) for seed in (101, 202))
    return row, starts - offsets[row], ends - starts, high, low


def window_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(row, start in the row, length, digest high, digest low) of all windows by row and start, and the chunks of each row."""
    row, start, length, *digests = chunk_rows(data, offsets)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    n = len(row)
    begin = offsets[row] + start
    end = begin + length
    onwards = np.searchsorted(end, begin + MIN_RUN)              # last chunk of the window from each chunk
    backwards = np.searchsorted(begin, end - MIN_RUN, "right") - 1   # first chunk of the window up to each chunk
    first, last = np.concatenate([np.arange(n), backwards]), np.concatenate([onwards, np.arange(n)])
    whole = (first >= 0) & (last < n)
    first, last = first[whole], last[whole]
    whole = row[first] == row[last]
    pair = np.unique(first[whole] * max(n, 1) + last[whole])
    first, last = pair // max(n, 1), pair % max(n, 1)
    chained = []
    for digest in digests:
        value = mix((last - first).astype(np.uint64))
        at, k = np.arange(len(first)), 0
        while len(at):
            value[at] = mix(value[at] ^ digest[first[at] + k].view(np.uint64))
            k += 1
            at = at[first[at] + k <= last[at]]
        chained.append(value.view(np.int64))
    return (row[first], start[first], end[last] - begin[first], *chained), per_row


WINDOW_SCHEMA = "doc_id bigint, start int, length int, high bigint, low bigint"
RESULT = ("doc_id bigint, n_bytes bigint, n_chunks bigint, n_removed bigint, n_spans bigint, "
          "spans array<struct<start:bigint,length:bigint>>, kept_sha256 string")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            (row, start, length, high, low), _ = window_rows(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, len(offsets) - 1).take(pa.array(row)), pa.array(start.astype(np.int32)),
                 pa.array(length.astype(np.int32)), pa.array(high), pa.array(low)],
                names=["doc_id", "start", "length", "high", "low"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, repeated windows of the id) to results."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        out = {"n_bytes": [], "n_chunks": [], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": []}
        places = batch.column(2).to_pylist()
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            (row, start, length, high, _), n_chunks = window_rows(data, offsets)
            first = np.searchsorted(row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                text, spans = data[offsets[r]:offsets[r + 1]], []
                if places[lo + r]:
                    # rows that share an id can differ: only windows that the row has itself count
                    own = set(zip(*[x[first[r]:first[r + 1]].tolist() for x in (start, length, high)]))
                    spans = merged([(p["start"], p["length"]) for p in places[lo + r] if (p["start"], p["length"], p["high"]) in own])
                keep = np.ones(len(text), dtype=bool)
                for s, n in spans:
                    keep[s:s + n] = False
                out["n_bytes"].append(len(text))
                out["n_chunks"].append(int(n_chunks[r]))
                out["n_removed"].append(sum(n for _, n in spans))
                out["n_spans"].append(len(spans))
                out["spans"].append([{"start": s, "length": n} for s, n in spans])
                out["kept_sha256"].append(hashlib.sha256(text[keep].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(v, span if k == "spans" else pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()],
            names=["doc_id", *out])


def runs(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of neighbouring places of ``MIN_RUN`` bytes or more."""
    return [(s, n) for s, n in merged(places) if n >= MIN_RUN]


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that places (start, length) cover together."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(set(places)):
        if out and out[-1][0] + out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], start + length - out[-1][0]))
        else:
            out.append((start, length))
    return out


def duplicates(narrow: DataFrame) -> DataFrame:
    """``(doc_id, start, length, high)`` of every window that is not the first of its digest; null ids as ``FIRST_ID``."""
    cut = narrow.mapInArrow(_windows, WINDOW_SCHEMA).withColumn("doc_id", F.coalesce("doc_id", F.lit(FIRST_ID)))
    repeated = materialise(
        cut.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"), "repeated-windows")
    likely = bloom.possible(cut, F.xxhash64("high", "low"), repeated, F.xxhash64("high", "low"), repeated.count(), max_blocks=1 << 18)
    met = materialise(likely.filter("_possible").drop("_possible").join(repeated, ["high", "low"]), "window-places")
    later = met.filter("doc_id > first_doc").select("doc_id", "start", "length", "high")
    # inside the first document the first place stays; such a group is part of one document
    inside = met.filter("doc_id = first_doc").select("doc_id", "start", "length", "high", "low").distinct()
    place = F.row_number().over(Window.partitionBy("high", "low", "doc_id").orderBy("start"))
    again = inside.withColumn("place", place).filter("place > 1").select("doc_id", "start", "length", "high")
    return later.unionByName(again)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; see the module text."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    found = duplicates(narrow).groupBy(F.col("doc_id").alias("removed_id")).agg(
        F.collect_set(F.struct(F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"), "high")).alias("places"))
    removed = materialise(found, "removed-windows")
    known = F.coalesce(F.col("doc_id"), F.lit(FIRST_ID))
    flagged = bloom.possible(narrow, known, removed, F.col("removed_id"), removed.count())
    none = F.lit(None).cast(removed.schema["places"].dataType)
    passed = flagged.filter(~F.col("_possible")).select("doc_id", "text", none.alias("places"))
    touched = flagged.filter("_possible").join(removed, known == F.col("removed_id"), "left").select("doc_id", "text", "places")
    return passed.mapInArrow(_removed, RESULT).unionByName(touched.mapInArrow(_removed, RESULT))
