"""Secret scans: base patterns, and a conditional random field that finds what they do not list.

Base spans are the leftmost non-overlapping matches of three patterns (``PATTERNS``);
matches below a length are dropped. They always stay.

For the field a text is a row of tokens: runs of letters, digits and non-ASCII
characters, and single other signs. A token's features are its shape (kinds of
characters, length, changes between kinds), its own sign or short word, the
signs and words on both sides, whether it stands right behind or before its
neighbours, and two features of the whole text (its share of signs and of
tokens with digits). Tags are begin, inside and outside (``crf.py``), decoded by
Viterbi; a secret holds no blank. Decoded spans that touch no base span are
added as kind ``crf``.

There are no labelled secrets, so the base spans teach the field: windows of
``WINDOW`` tokens around them, each once more with another key word or another
kind of secret in its place (``invented``: the field learns the neighbourhood and
shape of secrets, not the base patterns), and windows from anywhere as examples
of ordinary text. Of both sorts the ``MAX_WINDOWS`` with the smallest hashes over
all documents train, a bounded sample; windows of more than ``WINDOW_BYTES`` bytes
do not train. Everything else covers all rows and whole texts.

Result, one row per row of ``docs``: ``doc_id`` and ``spans`` (kind, start, end in code
points, end exclusive) by start, then kind in the order of ``KINDS``.

Defined cases: null counts as empty; empty texts have no spans; ids are handed
through, repeated or null; repeated rows fare alike; without any base span in
the corpus nothing is trained and only base spans (none) are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .tables import bounded_batches, materialise, text_of
from .text import IS_WORD, LOWER, buffers, chunks, hash_spans

# FIXED VALUES — base patterns with the shortest length that counts: of the value (assign, read in lower case) or the match
PATTERNS = [
    ("assign", re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(rb"[0-9a-f]+"), 24),
]
KINDS = ["assign", "access", "hex", "crf"]
KEYS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]  # what the first pattern begins with
ACCESS = b"AKIA"
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[[*b"0123456789abcdef"]] = True

WINDOW = 48
WINDOW_BYTES = 4096
MAX_WINDOWS = 3000      # of each sort
ORDINARY_EVERY = 8      # one text in so many offers an ordinary window
WORD_BUCKETS = 1 << 12
SIZES = np.array([1, 2, 3, 5, 8, 12, 16, 20, 24, 32, 48])


# --- base spans ---------------------------------------------------------------------------------------------------


def base_matches(data: bytes, lower: bytes, lo: int, hi: int) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the base spans of ``data[lo:hi]``, in bytes."""
    out = []
    for m in PATTERNS[0][1].finditer(lower, lo, hi):
        if m.end(2) - m.start(2) >= PATTERNS[0][2]:
            out.append(("assign", m.start(), m.end(), m.start(2)))
    for m in PATTERNS[1][1].finditer(data, lo, hi):
        if m.end() - m.start() >= PATTERNS[1][2]:
            out.append(("access", m.start(), m.end(), m.start()))
    for m in PATTERNS[2][1].finditer(data, lo, hi):
        if m.end() - m.start() >= PATTERNS[2][2]:
            out.append(("hex", m.start(), m.end(), m.start()))
    return out


def _places(needle: bytes, hay: bytes) -> list[int]:
    out, at = [], hay.find(needle)
    while at >= 0:
        out.append(at)
        at = hay.find(needle, at + 1)
    return out


def base_rows(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int, int]]]:
    """Row to its base spans. Patterns run only on rows with a key word, the access mark or enough hex digits in a run."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    places = [p for needle in KEYS for p in _places(needle, low)] + _places(ACCESS, raw)
    run, length = _IS_HEX[data], 1
    while length < PATTERNS[2][2] and len(run):
        step = min(length, PATTERNS[2][2] - length)
        run = run[:-step] & run[step:]
        length += step
    hit = np.concatenate([np.array(places, dtype=np.int64), np.flatnonzero(run)])
    rows = np.unique(np.searchsorted(offsets, hit, "right") - 1)
    found = {r: base_matches(raw, low, int(offsets[r]), int(offsets[r + 1])) for r in rows.tolist()}
    return {r: spans for r, spans in found.items() if spans}


# --- tokens and features ------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of a run of rows; ``first`` marks each row's first token, ``glued`` those right behind the one before."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    glued: np.ndarray
    is_word: np.ndarray
    row: np.ndarray
    row_first: np.ndarray


IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[:33] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    word, sign = IS_WORD[data], ~IS_WORD[data] & ~IS_BLANK[data]
    edge = np.zeros(len(data) + 2, dtype=bool)
    edge[1:-1] = word
    begins, ends = word & ~edge[:-2], word & ~edge[2:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[full] = word[full]
    ends[full[1:] - 1] = word[full[1:] - 1]
    start, end = np.flatnonzero(begins | sign), np.flatnonzero(ends | sign) + 1
    row_first = np.searchsorted(start, offsets)
    first = np.zeros(len(start), dtype=bool)
    first[row_first[:-1][row_first[:-1] < row_first[1:]]] = True
    glued = np.zeros(len(start), dtype=bool)
    glued[1:] = (start[1:] == end[:-1]) & ~first[1:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(row_first))
    return Tokens(start, end, first, glued, word[start], row, row_first)


def _kind_table() -> np.ndarray:
    """One bit per kind of sign: 1 digit, 2 lower case, 4 lower case behind f, 8 upper case, 16 anything else, 0 blank."""
    kind = np.where(IS_BLANK, 0, 16).astype(np.uint8)
    kind[ord("0"):ord("9") + 1] = 1
    kind[ord("a"):ord("f") + 1] = 2
    kind[ord("g"):ord("z") + 1] = 6
    kind[ord("A"):ord("Z") + 1] = 8
    return kind


_KIND = _kind_table()
TEMPLATES = 12
FEATURES = TEMPLATES << 13


def token_shapes(data: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(kinds of signs in each token, class of how often digits and others take turns in it)."""
    if not len(t.start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    digit = kind == 1
    turn = np.zeros(len(data), dtype=bool)
    turn[1:] = digit[1:] != digit[:-1]
    turn &= kind > 0
    turn[t.start] = False
    turns = np.add.reduceat(turn, t.start, dtype=np.int32)  # up to the next token: blanks count for nothing
    return np.bitwise_or.reduceat(kind, t.start).astype(np.int64), np.searchsorted([1, 2, 4, 8], turns, "right")


def file_features(t: Tokens, digits: np.ndarray, rows: int) -> np.ndarray:
    """Per row a number below 32: its share of signs (eighths) and of tokens with digits (quarters, steep)."""
    count = np.maximum(np.bincount(t.row, minlength=rows), 1)
    signs = np.bincount(t.row, ~t.is_word, minlength=rows) / count
    numbers = np.bincount(t.row, digits, minlength=rows) / count
    return (np.minimum(signs * 8, 7).astype(np.int64) * 4 + np.searchsorted([0.02, 0.08, 0.25], numbers))


def features(data: np.ndarray, t: Tokens, of_file: np.ndarray | None = None) -> np.ndarray:
    """template x token feature numbers; ``of_file`` overrides the rows' file features (for windows of other texts)."""
    n = len(t.start)
    shape, turns = token_shapes(data, t)
    digit = (shape & 1).astype(bool)
    size = np.searchsorted(SIZES, t.end - t.start, "right")
    sign = np.where(t.is_word, 0, data[t.start] if n else 0).astype(np.int64)
    lower = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    plain = t.is_word & ~digit & (t.end - t.start <= 24)
    name = np.zeros(n, dtype=np.int64)
    name[plain] = 1 + (hash_spans(lower, t.start[plain], t.end[plain], seed=5) % np.uint64(WORD_BUCKETS - 300)).astype(np.int64)
    identity = np.where(t.is_word, name, WORD_BUCKETS - 256 + sign)     # words and signs in one range; odd words 0

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        """The value ``step`` tokens away in the same row, else WORD_BUCKETS."""
        out = np.full(n, WORD_BUCKETS, dtype=np.int64)
        a, b = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
        if abs(step) < n:
            same = t.row[a] == t.row[b]
            out[b] = np.where(same, values[a], WORD_BUCKETS)
        return out

    index = np.arange(n)
    last_word = np.maximum.accumulate(np.where(t.is_word, index, -1)) if n else index
    before = np.concatenate([[-1], last_word[:-1]])[:n]
    near = (before >= 0) & (index - before <= 5)
    near &= t.row[before] == t.row
    word_before = np.where(near, name[before], WORD_BUCKETS)
    shape_size = shape * 16 + size
    next_glued = np.concatenate([t.glued[1:], [False]])[:n]
    glue = t.glued * 2 + next_glued
    files = file_features(t, digit, len(t.row_first) - 1) if of_file is None else of_file
    long = (size >= 5).astype(np.int64) + (size >= 8)
    numbers = [
        shape_size, shape_size * 8 + turns, identity, beside(identity, -1), beside(identity, 1), beside(identity, -2),
        word_before, word_before % 512 * 12 + np.minimum(size, 11), beside(shape_size, -1), glue * 1024 + shape_size,
        (files[t.row] * 3 + long) * 4 + glue, sign * 4 + glue,
    ]
    out = np.empty((TEMPLATES, n), dtype=np.int32)
    for k, x in enumerate(numbers):
        np.bitwise_and(x, 8191, out=out[k], casting="unsafe")
        out[k] += k << 13
    return out


# --- training windows ---------------------------------------------------------------------------------------------


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to windows: text, file feature, whether it holds a base span, and a hash to choose by."""
    for batch in batches:
        out: list[tuple[str, int, bool, int]] = []
        for _, data, offsets in chunks(*buffers(batch.column(0))):
            based, rows = base_rows(data, offsets), []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                chance = zlib.crc32(data[a:min(b, a + 256)], b - a)
                if r in based or (b > a and chance % ORDINARY_EVERY == 0):
                    rows.append((r, a, b, based.get(r, []), chance))
            if not rows:
                continue
            part = np.concatenate([np.zeros(1, np.int64), np.cumsum([b - a for _, a, b, _, _ in rows])])
            text = np.concatenate([data[a:b] for _, a, b, _, _ in rows])
            t = tokens(text, part)
            files = file_features(t, (token_shapes(text, t)[0] & 1).astype(bool), len(rows))
            for k, (_, a, b, found, chance) in enumerate(rows):
                lo, hi = int(t.row_first[k]), int(t.row_first[k + 1])
                if lo == hi:
                    continue
                centres = [(int(np.searchsorted(t.start, part[k] + s - a)), True) for _, _, _, s in found]
                if chance % ORDINARY_EVERY == 0:
                    centres.append((lo + chance // ORDINARY_EVERY % (hi - lo), False))
                for centre, holds in centres:
                    first = max(lo, min(centre - WINDOW // 2, hi - WINDOW))
                    last = min(hi, first + WINDOW) - 1
                    piece = text[t.start[first]:t.end[last]].tobytes()
                    if len(piece) <= WINDOW_BYTES:
                        out.append((piece.decode("utf-8", "replace"), int(files[k]), holds, zlib.crc32(piece, 7)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w[0] for w in out], pa.string()), pa.array([w[1] for w in out], pa.int32()),
             pa.array([w[2] for w in out], pa.bool_()), pa.array([w[3] for w in out], pa.int64())],
            names=["window", "file", "holds", "chance"])


def training_windows(docs: DataFrame, limit: int = MAX_WINDOWS) -> list[tuple[str, int, bool]]:
    """At most ``limit`` windows of each sort on the driver, the distinct ones with the smallest hashes.

    A bound on the hash, from their counted number, leaves some more than ``limit`` of a sort, however many
    there are; only these are ordered, and read by the driver.
    """
    bounded_batches(docs.sparkSession)
    found = materialise(docs.select(text_of(docs).alias("text")).mapInArrow(
        _windows, "window string, file int, holds boolean, chance bigint").distinct(), "secret-windows")
    counts = {r["holds"]: r["n"] for r in found.groupBy("holds").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    out = []
    for holds in (True, False):
        share = min(1.0, (1.5 * limit + 100) / max(counts.get(holds, 0), 1))
        near = found.filter((F.col("holds") == holds) & (F.col("chance") <= int(share * (1 << 32))))
        rows = near.orderBy("chance", "window", "file").limit(limit).collect()
        out += [(r["window"], r["file"], r["holds"]) for r in rows]
    return out


# kinds of secret and key words that stand in for those of a base span
_LETTERS = string.ascii_letters + string.digits
KEY_WORDS = [b"key", b"pwd", b"auth", b"bearer", b"credential", b"access_key", b"private_key", b"passphrase", b"signature", b"pass"]
FORMS = [(b" = ", b'"'), (b"=", b""), (b": ", b""), (b": ", b'"'), (b"='", b"'"), (b" ", b""), (b"", b"")]  # the last: no key word


def invented(rng: random.Random) -> str:
    """A made-up secret of a random kind."""
    def some(letters: str, a: int, b: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    return rng.choice([
        lambda: some(_LETTERS, 20, 44),
        lambda: some(_LETTERS + "+/", 24, 64) + rng.choice(["", "=", "=="]),
        lambda: some(string.ascii_uppercase + string.digits, 16, 24),
        lambda: some(string.ascii_lowercase, 2, 4) + rng.choice("_-") + some(_LETTERS, 16, 40),
        lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: some(_LETTERS, 8, 12) + rng.choice("._=+/-") + some(_LETTERS, 2, 6),
    ])()


def tagged(text: str, secrets: list[tuple[int, int]]) -> tuple[np.ndarray, Tokens, np.ndarray]:
    """(bytes, tokens, tags) of a window whose secrets are the given byte ranges."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    t = tokens(data, np.array([0, len(data)]))
    inside = np.zeros(len(data) + 1, dtype=bool)
    for a, b in secrets:
        inside[a:b] = True
    hit = inside[t.start] & inside[t.end - 1]
    after = np.concatenate([[False], hit[:-1]]) & t.glued
    return data, t, np.where(hit, np.where(after, crf.INSIDE, crf.BEGIN), crf.OUTSIDE)


def examples(windows: list[tuple[str, int, bool]], seed: int = 3):
    """Training arrays of ``crf.train`` from windows; see the module text."""
    rng = random.Random(seed)
    ready = []
    for text, file, holds in windows:
        raw = text.encode()
        found = base_matches(raw, LOWER[np.frombuffer(raw, np.uint8)].tobytes(), 0, len(raw))
        ready.append((*tagged(text, [(s, e) for _, _, e, s in found]), file))
        if holds and found:
            kind, start, end, secret = rng.choice(found)
            other, head, tail = invented(rng).encode(), raw[:secret], raw[end:]
            if kind == "assign":
                form, quote = rng.choice(FORMS)
                key = rng.choice([re.match(rb"[a-z_]+", raw[start:].lower()).group(), *KEY_WORDS])
                head = raw[:start] + (key + form if form else b"") + quote
                tail = quote + (tail[1:] if tail[:1] in (b'"', b"'") else tail)
            new = head + other + tail
            end = len(raw) - len(tail)
            shift = len(new) - len(raw)
            spans = [(s, e) for _, _, e, s in found if e <= start] + [(s + shift, e + shift) for _, _, e, s in found if s >= end]
            ready.append((*tagged(new.decode("utf-8", "replace"), [*spans, (len(head), len(head) + len(other))]), file))
    places = max(len(t.start) for _, t, _, _ in ready)
    places = min(places, 2 * WINDOW)
    shape = (len(ready), places)
    x = np.zeros((TEMPLATES, *shape), dtype=np.int64)
    tags, glued, used = np.full(shape, crf.OUTSIDE), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
    for k, (data, t, y, file) in enumerate(ready):
        n = min(len(t.start), places)
        x[:, k, :n] = features(data, t, np.array([file]))[:, :n]
        tags[k, :n], glued[k, :n], used[k, :n] = y[:n], t.glued[:n], True
    some = used[:, 0]
    return x[:, some], tags[some], glued[some], used[some]


def fit(docs: DataFrame, limit: int = MAX_WINDOWS) -> crf.Crf | None:
    """The field trained on the corpus' own base spans; None where there are none."""
    windows = training_windows(docs, limit)
    if not any(holds for _, _, holds in windows):
        return None
    return crf.train(*examples(windows), size=FEATURES).compact()


# --- scanning -----------------------------------------------------------------------------------------------------


def _spans(batches: Iterator[pa.RecordBatch], model: crf.Crf | None) -> Iterator[pa.RecordBatch]:
    kinds = np.array(KINDS, dtype=object)
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            rows = len(offsets) - 1
            found = [(r, s, KINDS.index(kind), e) for r, spans in base_rows(data, offsets).items() for kind, s, e, _ in spans]
            if model is not None:
                t = tokens(data, offsets)
                tag = model.decode(features(data, t), t.first, t.glued)
                begin = np.flatnonzero(tag == crf.BEGIN)
                stops = np.flatnonzero(tag != crf.INSIDE)
                after = np.concatenate([stops, [len(tag)]])[np.searchsorted(stops, begin, "right")] if len(begin) else begin
                s, e = t.start[begin], t.end[after - 1]
                covered = np.zeros(len(data) + 1, dtype=np.int64)
                for _, a, _, b in found:
                    covered[a + 1:b + 1] = 1
                covered = np.cumsum(covered)
                free = covered[e] == covered[s]
                found += list(zip(t.row[begin[free]].tolist(), s[free].tolist(), [3] * int(free.sum()), e[free].tolist()))
            found.sort()
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            row, s, kind, e = np.array(found, dtype=np.int64).reshape(-1, 4).T
            base = point[offsets[row]]
            bounds = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array(kinds[kind], pa.string()), pa.array(point[s] - base), pa.array(point[e] - base)], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, rows), pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """``doc_id, spans`` per row of ``docs``; without a model only base spans. See the module text."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", text_of(docs).alias("text"))
    return narrow.mapInArrow(lambda batches: _spans(batches, model),
                             f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
