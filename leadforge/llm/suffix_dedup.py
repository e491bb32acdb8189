"""Removal of repeated 100-byte strings, with suffix arrays over candidate places.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier
(smaller id, or same document and earlier start). Results are exact but for equal
64-bit hashes of different strings.

*Anchors.* A place is an anchor if the rank of its ``GRAM``-byte hash is the least
of some window of neighbouring ranks that one ``LENGTH``-byte string spans. Every such
string holds an anchor at a place that depends on its content alone, so equal
strings meet at equal anchors, and all of them that hold an anchor lie within
its *context*: the ``REACH`` bytes before it and the ``LENGTH`` bytes from it.

*Copies.* Anchors that occur once are no candidates; a partially aggregated count
and a Bloom filter drop them. Equal contexts at equal anchors form a class. All
but the first place of a class are removed whole, the first one goes on if its
anchor has other contexts too: there, repeats begin or end.

*Suffix arrays.* The contexts that go on meet by anchor. Aligned at the anchor,
they are sequences of 16-byte symbols; a task takes whole anchor groups, ``AT_ONCE``
contexts or more at a time, and sorts the suffixes by linear grouping
(:mod:`.suffix_array`). Symbols that no other context has at the same place lie in
no shared core, nor do runs of fewer than five others; they are left out. Neighbours
in the suffix array that share five symbols or more are the contexts with a common
core of 80 bytes, and their at most sixteen windows around it are compared by 64-bit
hashes and ordered by place.

*Hot anchors.* An anchor with more than ``HOT`` contexts (a line that stands in
a third of all documents) does not go to one task: its contexts are counted by
core first, and windows around shared cores by content, each partially
aggregated. Nothing is dropped.

Only texts that hold such contexts or lose bytes are shuffled.

Result, one row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans``
(maximal removed runs) and ``kept_sha256`` of the bytes that stay.

Defined cases: null counts as empty; texts of fewer than ``LENGTH`` bytes lose
nothing; rows that repeat an id are one document, so repeated rows fare alike
(the table's ids are taken to identify its texts); a null id comes before all
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .suffix_array import END, joint_suffix_array
from .tables import bounded_batches, materialise, text_of
from .text import buffers, chunks, lanes, mix

LENGTH = 100
GRAM = 32                       # a power of two
REACH = LENGTH - GRAM           # bytes of a string before its anchor, at most
ZONE = 16                       # string starts that share a core; also the bytes of a symbol
ZONES = REACH // ZONE + 1
LEAD = (ZONES - 1) * ZONE       # bytes before the anchor at which a context's first symbol starts
SYMBOLS = (LEAD + LENGTH) // ZONE
SHARED = (LENGTH - ZONE + 1) // ZONE  # symbols that lie whole in every string of a zone
AT_ONCE = 1000
HOT = 40_000                    # contexts of one anchor that a task takes: some 7 MB
CHUNK = 1 << 17                 # bytes of text that anchors are sought in at once
FIRST_ID = -(1 << 63)

_FOLD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]
_HIGH = np.uint64(32)


class Hashes:
    """Hashes of the ``GRAM`` bytes from every place; of longer spans from these. Zeros stand behind the data."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + GRAM + 8, dtype=np.uint8)
        padded[:len(data)] = data
        words = mix(lanes(padded)[:len(data) + GRAM - 8])
        half = words[:-8] * _FOLD[0]
        half += words[8:]
        self.gram = half[:-16] * _FOLD[1]
        self.gram += half[16:]

    def span(self, at: np.ndarray, length: int | np.ndarray, longest: int | None = None) -> np.ndarray:
        """Of ``length`` bytes, ``GRAM`` or more; lengths that differ need the ``longest`` there may be."""
        last = at + length - GRAM
        out = np.zeros(len(at), dtype=np.uint64) + np.asarray(length, dtype=np.uint64)
        for k in range(-(-(longest or length) // GRAM)):
            out = mix(out ^ self.gram[np.minimum(at + k * GRAM, last)])
        return out


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """Minimum or maximum over the ``width`` places from each one on that has as many."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = op(values[:-step], values[step:]), have + step
    return values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place, row, bytes before, bytes from it on, anchor hash); the two lengths are those of the context."""
    h = Hashes(data)
    n = len(data)
    width = LENGTH - GRAM + 1
    if n < LENGTH:
        empty = np.zeros(0, dtype=np.int64)
        return h, empty, empty, empty, empty, empty.view(np.uint64)
    ranked = ((h.gram[:n - GRAM + 1] * _FOLD[2]) >> _HIGH).astype(np.uint32)
    ranked |= np.uint32(1)                        # 0: none
    least = np.zeros(n - LENGTH + 1 + 2 * (width - 1), dtype=np.uint32)
    inner = least[width - 1:len(least) - width + 1]
    inner[:] = _sliding(ranked, width, np.minimum)
    over = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()  # strings that would leave the text
    inner[over[(over >= 0) & (over < len(inner))]] = 0
    place = np.flatnonzero(_sliding(least, width, np.maximum) == ranked)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(place, offsets)))
    before = np.minimum(REACH, place - offsets[row])
    after = np.minimum(LENGTH, offsets[row + 1] - place)
    keep = before + after >= LENGTH
    return h, place[keep], row[keep], before[keep], after[keep], mix(h.gram[place[keep]])


def context_hashes(h: Hashes, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(h.span(place - before, before + after, REACH + LENGTH) ^ before.astype(np.uint64))


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(", ")]


REPEATS = "anchor bigint"


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in chunks(*buffers(batch.column(1)), limit=CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offsets)[-1].view(np.int64))], names=_names(REPEATS))


ANCHORS = "doc_id bigint, anchor bigint, context bigint, place int, before int, after int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1)), limit=CHUNK):
            h, place, row, before, after, gram = anchors(data, offsets)
            if len(place):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(offsets) - 1).take(pa.array(row)), pa.array(gram.view(np.int64)),
                    pa.array(context_hashes(h, place, before, after).view(np.int64)),
                    *[pa.array(x.astype(np.int32)) for x in (place - offsets[row], before, after)]], names=_names(ANCHORS))


CONTEXTS = "doc_id bigint, anchor bigint, place int, before int, after int, hot boolean, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places wanted in them to a row for each place with the context's bytes."""
    for batch in batches:
        doc, places = np.asarray(batch.column(0)), batch.column(2)
        first = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))])
        flat = dict(zip(("anchor", "place", "before", "after", "hot"), places.flatten().flatten()))
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            rows = len(offsets) - 1
            own = slice(first[lo], first[lo + rows])
            row = np.repeat(np.arange(rows), np.diff(first[lo:lo + rows + 1]))
            at, before, after = (np.asarray(flat[k])[own].astype(np.int64) for k in ("place", "before", "after"))
            here = np.flatnonzero(at + after <= offsets[row + 1] - offsets[row])  # else of another row with this id
            row, at, before, after = row[here], at[here], before[here], after[here]
            size = before + after
            ends = np.concatenate([[0], np.cumsum(size)])
            raw = data[np.repeat(offsets[row] + at - before - ends[:-1], size) + np.arange(ends[-1])]
            binary = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[lo + row]), flat["anchor"].slice(first[lo], own.stop - own.start).take(pa.array(here)),
                *[pa.array(x.astype(np.int32)) for x in (at, before, after)],
                flat["hot"].slice(first[lo], own.stop - own.start).take(pa.array(here)), binary], names=_names(CONTEXTS))


def padded_contexts(raw: pa.Array, before: np.ndarray) -> np.ndarray:
    """rows x (REACH + LENGTH) bytes, each anchor at column ``REACH``; missing bytes are zero."""
    width = REACH + LENGTH
    data, offsets = buffers(raw)
    flat = np.zeros(len(raw) * width, dtype=np.uint8)
    start = np.arange(len(raw)) * width + REACH - before
    flat[np.repeat(start - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data
    return flat.reshape(len(raw), width)


def shared_cores(table: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, context, zone): contexts whose zone has its core in common with another's, from one suffix array."""
    rows = len(table)
    halves = np.ascontiguousarray(table[:, REACH - LEAD:REACH - LEAD + ZONE * SYMBOLS]).view("<u8").astype(np.uint64)
    body = mix(mix(halves[:, ::2]) ^ halves[:, 1::2])  # equal symbols have equal numbers
    column = np.arange(SYMBOLS)
    whole = (ZONE * column - LEAD >= -before[:, None]) & (ZONE * (column + 1) - LEAD <= after[:, None])
    _, rank = np.unique(body, return_inverse=True)
    rank = rank.reshape(body.shape).astype(np.int64)
    # a core lies in symbols that another context has at the same place too; runs of fewer hold none
    of_column = rank * SYMBOLS + column
    repeated = whole & (np.bincount(of_column[whole], minlength=of_column.max(initial=0) + 1)[of_column] > 1)
    usable = np.zeros((rows, SYMBOLS + 1), dtype=bool)
    for k in range(ZONES):
        usable[:, k:k + SHARED] |= repeated[:, k:k + SHARED].all(axis=1, keepdims=True)
    usable[:, SYMBOLS] = usable.any(axis=1)
    context, at = np.nonzero(usable)
    sequence = np.concatenate([rank, np.full((rows, 1), END)], axis=1)[usable]
    order = np.array(joint_suffix_array(sequence), dtype=np.int64)
    ahead = np.concatenate([sequence, np.full(SHARED, END)])
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(SHARED):
        symbol = ahead[order + k]
        same &= (symbol[:-1] == symbol[1:]) & (symbol[1:] != END)
    interval = np.concatenate([np.zeros(min(len(order), 1), dtype=np.int64), np.cumsum(~same)])
    context, at = context[order], at[order]
    zone = ZONES - 1 - at                         # the strings of zone z hold the symbols from ZONES - 1 - z on
    keep = (zone >= 0) & (zone < ZONES)
    interval, context, zone = interval[keep], context[keep], zone[keep]
    key = interval * ZONES + zone
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    some = count[inverse] > 1
    return key[some], context[some], zone[some]


def window_spans(table: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, length) of what goes: windows that another context with a smaller place also has."""
    key, context, zone = shared_cores(table, before, after)
    used, context = np.unique(context, return_inverse=True)
    table, before, after, doc, place = table[used], before[used], after[used], doc[used], place[used]
    h = Hashes(table.ravel())
    r = np.arange(ZONE)
    lead = (zone[:, None] * ZONE + r).ravel()     # bytes of the window before the anchor
    context, key = np.repeat(context, ZONE), np.repeat(key, ZONE) * ZONE + np.tile(r, len(key))
    fits = (lead <= before[context]) & (LENGTH - lead <= after[context]) & (lead <= REACH)
    lead, context, key = lead[fits], context[fits], key[fits]
    content = h.span(context * table.shape[1] + REACH - lead, LENGTH)
    start = place[context] - lead
    order = np.lexsort((start, doc[context], content, key))
    key, content, context, start = key[order], content[order], context[order], start[order]
    # equal strings share a run of the order: all but the run's first place go
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), dtype=bool), (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
    lead_of = np.repeat(first, np.diff(np.append(first, len(key))))
    again = (doc[context] != doc[context[lead_of]]) | (start != start[lead_of])
    d, s = doc[context[again]], start[again]
    return merged(d, s, np.full(len(s), LENGTH))


def merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each document."""
    if not len(doc):
        return doc, start, length
    ids, doc = np.unique(doc, return_inverse=True)
    base = doc * (int((start + length).max()) + 1)  # documents stand apart
    order = np.argsort(base + start, kind="stable")
    low, reached = (base + start)[order], np.maximum.accumulate((base + start + length)[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > reached[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    return ids[doc[order[first]]], start[order[first]], reached[last] - low[first]


SPANS = "doc_id bigint, start int, length int"


def _spans_of(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=_names(SPANS))


def _by_suffix_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to spans; whole anchor groups, ``AT_ONCE`` contexts or more at a time."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        doc, place, before, after = (rows.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3, 4))
        return _spans_of(*window_spans(padded_contexts(rows.column(5), before), before, after, doc, place))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < AT_ONCE:
            continue
        # up to the last border between anchors
        anchor = np.asarray(batch.column(1))
        last = np.asarray(held[-2].column(1))[-1:] if len(held) > 1 else anchor[:1]
        border = np.flatnonzero(np.concatenate([last, anchor[:-1]]) != anchor)
        if len(border):
            cut = int(border[-1])
            yield solve([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield solve(held)


WINDOWS = "core bigint, doc_id bigint, first int, windows array<bigint>"


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of hot anchors to a row for each zone: hash of its core, hashes of its windows from start ``first`` down."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, place, before, after = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 2, 3, 4))
        table = padded_contexts(batch.column(6), before)
        h, base = Hashes(table.ravel()), np.arange(len(table)) * table.shape[1] + REACH
        for zone in range(ZONES):
            low, high = zone * ZONE, min(zone * ZONE + ZONE - 1, REACH)
            own = np.flatnonzero((low <= before) & (LENGTH - high <= after))
            if not len(own):
                continue
            core = mix(h.span(base[own] - low, low + LENGTH - high) + np.uint64(zone))
            lead = np.arange(low, high + 1)
            fits = (lead[None, :] <= before[own, None]) & (LENGTH - lead[None, :] <= after[own, None])
            content = np.stack([mix(h.span(base[own] - k, LENGTH)) for k in lead], axis=1).view(np.int64)
            windows = [[w if ok else None for w, ok in zip(ws, oks)] for ws, oks in zip(content.tolist(), fits.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(core.view(np.int64)), pa.array(doc[own]), pa.array((place[own] - low).astype(np.int32)),
                pa.array(windows, pa.list_(pa.int64()))], names=_names(WINDOWS))


def _hot_spans(contexts: DataFrame) -> DataFrame:
    zones = materialise(contexts.filter("hot").mapInArrow(_hot_windows, WINDOWS), "hot-zones")
    cores = materialise(zones.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"), "hot-cores")
    likely = bloom.possible(zones, F.col("core"), cores, F.col("core"), cores.count(), max_blocks=1 << 18).filter("_possible")
    windows = materialise(
        likely.select("core", "doc_id", "first", F.posexplode("windows").alias("k", "content")).filter("content is not null")
        .select("core", "content", "doc_id", (F.col("first") - F.col("k")).alias("start")), "hot-windows")
    return _all_but_first(windows, ["core", "content"]).select("doc_id", "start", F.lit(LENGTH).alias("length"))


def _all_but_first(places: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``places`` (``doc_id, start`` and the key) but the first place of each key; a hot key costs no task its rows."""
    firsts = materialise(
        places.groupBy(*key).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    met = places.join(firsts, key)
    later = met.filter("doc_id > first_doc")
    inside = met.filter("doc_id = first_doc")  # part of one document
    return later.unionByName(inside.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key, "doc_id").orderBy("start")))
                             .filter("nth > 1").drop("nth"))


def removed_spans(narrow: DataFrame) -> DataFrame:
    """``(doc_id, start, length)`` of what goes, parts of documents overlapping; null ids as ``FIRST_ID``."""
    found = narrow.mapInArrow(_anchors, ANCHORS)
    repeated = materialise(
        narrow.mapInArrow(_anchor_hashes, REPEATS).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"),
        "repeated-anchors")
    likely = bloom.possible(found, F.col("anchor"), repeated, F.col("anchor"), repeated.count(), max_blocks=1 << 18)
    met = materialise(likely.filter("_possible").drop("_possible").join(repeated, "anchor"), "anchor-places")

    # classes of equal contexts
    classes = materialise(
        met.groupBy("anchor", "context").agg(F.min("doc_id").alias("first_doc")), "context-classes")
    placed = materialise(met.join(classes, ["anchor", "context"]), "class-places")
    inside = placed.filter("doc_id = first_doc").withColumn(
        "nth", F.dense_rank().over(Window.partitionBy("anchor", "context", "doc_id").orderBy("place")))
    copies = placed.filter("doc_id > first_doc").select("doc_id", "place", "before", "after").unionByName(
        inside.filter("nth > 1").select("doc_id", "place", "before", "after"))
    copies = copies.select("doc_id", (F.col("place") - F.col("before")).alias("start"), (F.col("before") + F.col("after")).alias("length"))

    # the first places of anchors with several contexts
    several = materialise(
        classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")),
        "several-contexts")
    # one row each, so that nothing behind the join needs its rows dealt by anchor: it may split a hot one
    firsts = placed.filter("doc_id = first_doc").withColumn(
        "nth", F.row_number().over(Window.partitionBy("anchor", "context", "doc_id").orderBy("place"))).filter("nth = 1").select(
        "doc_id", "anchor", "place", "before", "after").join(several, "anchor")
    by_doc = materialise(
        firsts.groupBy(F.col("doc_id").alias("wanted_id")).agg(
            F.collect_list(F.struct("anchor", "place", "before", "after", "hot")).alias("places")), "wanted-places")
    near = bloom.possible(narrow, F.col("doc_id"), by_doc, F.col("wanted_id"), by_doc.count()).filter("_possible")
    contexts = materialise(
        near.join(by_doc, near["doc_id"] == by_doc["wanted_id"]).select("doc_id", "text", "places").mapInArrow(_contexts, CONTEXTS),
        "contexts")
    sorted_by_anchor = contexts.filter("not hot").select("doc_id", "anchor", "place", "before", "after", "bytes").repartition(
        "anchor").sortWithinPartitions("anchor", "doc_id", "place")
    return copies.unionByName(sorted_by_anchor.mapInArrow(_by_suffix_array, SPANS)).unionByName(_hot_spans(contexts))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2)
        first = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        start, length = (np.asarray(x).astype(np.int64) for x in spans.flatten().flatten())
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            rows = len(offsets) - 1
            own = slice(first[lo], first[lo + rows])
            row = np.repeat(np.arange(rows), np.diff(first[lo:lo + rows + 1]))
            low, end = offsets[row] + start[own], offsets[row + 1]
            depth = np.bincount(np.minimum(low, end), minlength=len(data) + 1) - np.bincount(
                np.minimum(low + length[own], end), minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            filled = offsets[:-1][np.diff(offsets) > 0]
            begins[filled] = gone[filled]
            removed, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
            kept, border = data[~gone], (offsets - removed).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, rows), *[pa.array(np.diff(x)) for x in (offsets, removed, runs)],
                pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(border, border[1:])], pa.string())], names=_names(RESULT))


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; see the module text."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("id"), F.coalesce(docs["doc_id"].cast("bigint"), F.lit(FIRST_ID)).alias("doc_id"),
                         text_of(docs).alias("text"))
    spans = removed_spans(narrow.select("doc_id", "text"))
    by_doc = materialise(
        spans.groupBy(F.col("doc_id").alias("span_id")).agg(F.collect_set(F.struct("start", "length")).alias("spans")), "removed-spans")
    flagged = bloom.possible(narrow, F.col("doc_id"), by_doc, F.col("span_id"), by_doc.count())
    none = F.lit(None).cast(by_doc.schema["spans"].dataType)
    passed = flagged.filter(~F.col("_possible")).select(F.col("id").alias("doc_id"), "text", none.alias("spans"))
    touched = flagged.filter("_possible").join(by_doc, F.col("doc_id") == F.col("span_id"), "left").select(
        F.col("id").alias("doc_id"), "text", "spans")
    return passed.mapInArrow(_kept, RESULT).unionByName(touched.mapInArrow(_kept, RESULT))
