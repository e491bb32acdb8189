"""Spelling variants of a vocabulary: words one edit apart, found in a bidirectional FM-index.

A word splits into halves. A word one edit away shares one half exactly: the
search matches the left half and extends to the right over the other, allowing
one error there, or matches the right half and extends to the left
(``fm_index.one_error``). What the second search finds with an equal left half is
left to the first, so no pair counts twice.

The vocabulary is dealt into buckets, once by the hash of the words' first and
once by the hash of their last code points: as many as the shorter half of the
shortest word has, so words that share a half are in one bucket. The number of
buckets follows the vocabulary's size. A bucket with more than ``BLOCK_LETTERS``
code points is cut into blocks, and every block is searched for the words of
every block, one task each: no task holds more than two blocks however the words
fall, and each pair of words meets once. Only a count and the best neighbour per
word leave a task.

A word's *form* is its neighbour of largest count (ties: the smallest in
code-point order), if that count is ``RATIO`` times its own or more; following forms
to the last gives its *root*. Counts at least double on the way, so pointer
jumping ends after few rounds.

Defined cases: null texts count as empty; a null id leaves its words as they
are; ids may repeat; a word without neighbours has 0 and nulls, and is its own
root; an empty vocabulary gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fm_index
from .tables import bounded_batches, materialise, text_of
from .text import LOWER, buffers, chunks

MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
BUCKET_LETTERS = 1 << 16
BLOCK_LETTERS = 1 << 18
MAX_SYMBOLS = 250  # the index keeps a symbol in a byte

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[ord("A"):ord("Z") + 1] = True
IS_LETTER[ord("a"):ord("z") + 1] = True
LATIN = 0xC3  # lead byte of U+00C0 to U+00FF in UTF-8, and of nothing else


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & np.uint32(1), (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte span, continued from the crc32 ``before`` it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, step = np.flatnonzero(end > start), 0
    while len(at):
        now = state[at]
        state[at] = _CRC[(now ^ data[start[at] + step]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        step += 1
        at = at[start[at] + step < end[at]]
    return state ^ np.uint32(0xFFFFFFFF)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of letters; a row's border ends a run."""
    lead = data == LATIN
    inside = IS_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 2, dtype=bool)
    edge[1:-1] = inside
    begins, ends = inside & ~edge[:-2], inside & ~edge[2:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _counted(batches: Iterator[pa.RecordBatch], drop_one_in: int, min_letters: int) -> Iterator[pa.RecordBatch]:
    """Rows (id as text, text) to (word, n) of a stretch of rows; see ``word_counts``."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            data = LOWER[data]
            start, end = letter_runs(data, offsets)
            leads = np.concatenate([[0], np.cumsum(data == LATIN)])
            letters = end - start - (leads[end] - leads[start])
            at = np.flatnonzero(letters >= min_letters)
            start, end, letters = start[at], end[at], letters[at]
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            edge[start] += 1
            np.add.at(edge, end, -1)
            inside = np.cumsum(edge[:-1]) > 0
            size = end - start
            if drop_one_in:
                row = np.searchsorted(offsets, start, "right") - 1
                known = np.array([k is not None for k in keys[lo:lo + len(offsets) - 1]], dtype=bool)
                before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys[lo:lo + len(offsets) - 1]], dtype=np.uint32)
                check = crc32_spans(data, start, end, before[row])
                for i in np.flatnonzero((check % np.uint32(drop_one_in) == 0) & known[row]).tolist():
                    run = data[start[i]:end[i]].tobytes().decode()
                    k = int(check[i]) % len(run)
                    a = start[i] + len(run[:k].encode())
                    b = a + len(run[k].encode())
                    inside[a:b] = False
                    size[i] -= b - a
                    letters[i] -= 1
                for i in np.flatnonzero(letters < min_letters).tolist():
                    inside[start[i]:end[i]] = False
                size = size[letters >= min_letters]
            places = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays(
                [found.field("values").cast(pa.large_string()).cast(pa.string()), found.field("counts")], names=["word", "n"])


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_one_in: int = 0) -> DataFrame:
    """``(word, n)`` of the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of all texts.

    With ``drop_one_in`` the runs whose ``crc32('<doc_id>:<run>')`` it divides lose the code point at
    that number modulo their length before they count. Counts are summed a batch at a time before
    the shuffle.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("string").alias("key"), text_of(docs).alias("text"))
    found = narrow.mapInArrow(lambda batches: _counted(batches, drop_one_in, min_letters), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


SEARCHED = "word string, n bigint, n_near bigint, best struct<minus:bigint,word:string>"


def _symbols(words: pa.Array, alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, alphabet): the code points' numbers from 1; unknown ones get the next number."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy())]).astype(np.int64)
    if alphabet is None:
        alphabet = np.unique(points)
        if len(alphabet) > MAX_SYMBOLS:
            raise ValueError(f"words of more than {MAX_SYMBOLS} different code points")
    at = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(at, len(alphabet) - 1)] == points
    return np.where(known, at, len(alphabet)).astype(np.uint8) + 1, offsets, alphabet


def _same_start(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` symbols from the places ``at_a`` of ``a`` and ``at_b`` of ``b`` are equal."""
    same = np.ones(len(size), dtype=bool)
    open_, step = np.flatnonzero(size > 0), 0
    while len(open_):
        equal = a[at_a[open_] + step] == b[at_b[open_] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal]
        open_ = open_[size[open_] > step]
    return same


def search(table: pa.Table, right: bool) -> pa.Table:
    """Search one block for the words of one block: columns word, n, indexed, asked."""
    known = table.filter(table["indexed"])
    known = known.take(pc.sort_indices(known, [("word", "ascending")])) if len(known) else known
    asked = table.filter(table["asked"])
    words, queries = known["word"].combine_chunks(), asked["word"].combine_chunks()
    n_near = np.zeros(len(queries), dtype=np.int64)
    best: list = [None] * len(queries)
    if len(words) and len(queries):
        letters, offsets, alphabet = _symbols(words)
        own, own_offsets, _ = _symbols(queries, alphabet)
        index = fm_index.Index(letters, offsets, len(alphabet) + 1)
        query, rank = fm_index.one_error(index, own, own_offsets, right)
        if not right:
            half = np.diff(own_offsets)[query] // 2
            fits = np.diff(offsets)[rank] >= half
            apart = np.ones(len(query), dtype=bool)
            apart[fits] = ~_same_start(own, own_offsets[query[fits]], letters, offsets[rank[fits]], half[fits])
            query, rank = query[apart], rank[apart]
        n_near = np.bincount(query, minlength=len(queries))
        count = known["n"].to_numpy()[rank]
        order = np.lexsort([rank, -count, query])
        query, rank, count = query[order], rank[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
        for q, c, w in zip(query[first].tolist(), count[first].tolist(), words.take(pa.array(rank[first])).to_pylist()):
            best[q] = {"minus": -c, "word": w}
    return pa.table({"word": queries, "n": asked["n"], "n_near": pa.array(n_near, pa.int64()),
                     "best": pa.array(best, pa.struct([("minus", pa.int64()), ("word", pa.string())]))})


def _search_right(table: pa.Table) -> pa.Table:
    return search(table, right=True)


def _search_left(table: pa.Table) -> pa.Table:
    return search(table, right=False)


def _units(words: DataFrame, key, buckets: int, block_letters: int) -> DataFrame:
    """Words dealt to (bucket, block to search, block of queries); a word is indexed, asked or both in a unit."""
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = dealt.groupBy("bucket").agg(F.ceil(F.sum("letters") / block_letters).cast("int").alias("blocks"))
    placed = dealt.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), "blocks").cast("int"))
    unit = F.explode(F.expr(
        "concat(transform(sequence(0, blocks - 1), x -> struct(own as i, x as j, true as indexed, x = own as asked)), "
        "filter(transform(sequence(0, blocks - 1), x -> struct(x as i, own as j, false as indexed, true as asked)), u -> u.i <> own))"))
    return placed.select("word", "n", "bucket", unit.alias("unit")).select("bucket", "unit.*", "word", "n")


def neighbours(words: DataFrame, min_letters: int = MIN_LETTERS, bucket_letters: int = BUCKET_LETTERS,
               block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``(word, n, n_near, best)`` for distinct words of ``min_letters`` code points or more and their counts;
    ``best`` has the largest count (negated, ``minus``) and its word, null without a neighbour."""
    words = words.withColumn("letters", F.char_length("word"))
    total = words.agg(F.sum("letters").alias("t")).first()["t"] or 0
    buckets = max(1, -(-total // bucket_letters))
    # a search costs far more than its bytes tell, so the number of tasks is not left to their size
    set_parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(buckets, max(set_parts, buckets // 8))
    left = min_letters // 2
    ends = ((_search_right, F.substring("word", 1, left)), (_search_left, F.expr(f"right(word, {min_letters - left})")))
    found = [_units(words, key, buckets, block_letters).repartition(parts, "bucket", "i", "j")
             .groupBy("bucket", "i", "j").applyInArrow(searched, SEARCHED) for searched, key in ends]
    return found[0].unionByName(found[1]).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(words: DataFrame, min_letters: int = MIN_LETTERS, ratio: int = RATIO,
                      bucket_letters: int = BUCKET_LETTERS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of a ``(word, n)`` vocabulary; see the module text."""
    near = neighbours(words, min_letters, bucket_letters, block_letters)
    fits = -F.col("best.minus") >= ratio * F.col("n")
    table = materialise(near.select(
        "word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")),
        "word-forms")
    ends = table.filter("form is not null").select("word", F.col("form").alias("root"))
    moved = True
    while moved:  # a jump doubles the way covered; forms never form a circle, as counts grow along them
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        jumped = materialise(ends.join(onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "word-roots")
        moved = not jumped.filter("moved").isEmpty()
        ends = jumped.select("word", "root")
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
