"""Toxicity: a convolutional text classifier trained in numpy.

A word is embedded by two hashed tables, one for the word and one for its first
four bytes. Filters of widths 1, 2 and 3 run over all words of a text; the
maximum of each filter over the whole text (0 at least) feeds a logistic
output.

Training uses a bounded sample of labelled rows (``MAX_TRAIN`` documents of at
most ``MAX_TRAIN_CHARS`` characters, the ones with the smallest id hashes),
gathered as bucket numbers. Part A of it gives each bucket's smoothed label
log-odds, from which the embeddings start; part B trains all weights by Adam;
part C fits a logistic calibration of the score and, for each language with
``MIN_LANGUAGE`` rows there, the threshold of best F1 (others take the overall
one). The score never sees labels, language, source or id; the language only
picks the threshold that decides ``rejected``.

Scoring reads every word of every text in one pass without a shuffle; the model
has a fixed size and travels with the task.

Defined cases: null and empty texts have no words and score what the output
layer says to zeros; documents of fewer words than a filter is wide give that
filter 0; without labels of both kinds the score is the share of toxic labels
(0 without labels) and nothing is rejected; rows without a label are not
trained on; of several labels of one id the largest counts; repeated rows are
scored each; other columns are handed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bounded_batches, text_of
from .text import Words, buffers, chunks, hash_spans, word_hashes, words

BUCKETS = 1 << 17
DIM = 4                 # of each of the two tables
WIDTHS = (1, 2, 3)
FILTERS = 6             # of each width
MAX_TRAIN = 8000
MAX_TRAIN_CHARS = 100_000
MIN_DOCS = 3            # documents of part A a bucket needs to be embedded
MIN_LANGUAGE = 60
EPOCHS = 4
BATCH = 48
CUT = 0.7


def buckets_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of its first four bytes."""
    head = hash_spans(w.lower, w.start, np.minimum(w.end, w.start + 4), seed=1)
    mask = np.uint64(BUCKETS - 1)
    return (word_hashes(w) & mask).astype(np.int32), (head & mask).astype(np.int32)


@dataclass
class Model:
    word: np.ndarray                      # BUCKETS x DIM
    head: np.ndarray
    taps: list[np.ndarray] = field(default_factory=list)   # for each width: width x 2 DIM x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    by_language: dict[str, float] = field(default_factory=dict)

    def pooled(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, places: bool = False):
        """Maxima of all filters for each text; with ``places`` also where they are."""
        x = np.concatenate([self.word[a], self.head[b]], axis=1)
        rows = len(first) - 1
        result = np.zeros((rows, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.full(result.shape, -1, dtype=np.int64)
        count = np.diff(first)
        for k, width in enumerate(WIDTHS):
            n = len(x) - width + 1
            if n <= 0:
                continue
            act = x[:n] @ self.taps[k][0]
            for j in range(1, width):
                act += x[j:j + n] @ self.taps[k][j]
            act += self.bias[k]
            if width > 1:  # windows that reach into the next text
                for j in range(1, width):
                    over = first[1:-1] - j
                    act[over[(over >= 0) & (over < n)]] = -1.0
            full = np.flatnonzero((count > 0) & (first[:-1] < n))
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if len(full):
                result[full, cols] = np.maximum(np.maximum.reduceat(act, first[full]), 0)
                if places:
                    for r in full:
                        where[r, cols] = first[r] + act[first[r]:min(first[r + 1], n)].argmax(axis=0)
        return (result, where, x) if places else result

    def logit(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(a, b, first).astype(np.float64) @ self.out + self.out_bias

    def score(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logit(a, b, first) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def constant_model(share: float) -> Model:
    """A model that gives every text the same score."""
    none = np.zeros((BUCKETS, DIM), np.float32)
    logit = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    return Model(none, none, [np.zeros((w, 2 * DIM, FILTERS), np.float32) for w in WIDTHS],
                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS], shift=logit, slope=0.0)


def log_odds(docs: list[np.ndarray], labels: np.ndarray, prior: float = 10.0) -> np.ndarray:
    """Smoothed log-odds of each bucket against the share of label 1; 0 for buckets in few documents."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, y in zip(docs, labels):
        u = np.unique(d)
        seen[u] += 1
        toxic[u] += y
    share = labels.mean()
    odds = np.log((toxic + prior * share) / (seen - toxic + prior * (1 - share))) - np.log(share / (1 - share))
    return np.where(seen >= MIN_DOCS, odds, 0.0)


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, t: int) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m *= 0.9
    m += 0.1 * grad
    v *= 0.999
    v += 0.001 * grad * grad
    value -= (rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(value.dtype)


def train(a: list[np.ndarray], b: list[np.ndarray], labels: np.ndarray, langs: list, seed: int = 11) -> Model:
    """Fit on texts given as bucket numbers of words (``a``) and word heads (``b``)."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or not 0 < labels.mean() < 1:
        return constant_model(float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    part = np.zeros(len(labels), dtype=int)
    for y in (0, 1):  # both labels in every part, as far as they go
        at = rng.permutation(np.flatnonzero(labels == y))
        part[at] = np.array([0, 1, 0, 1, 2])[np.arange(len(at)) % 5]
    rows = [np.flatnonzero(part == p) for p in range(3)]
    rows = [r if len(r) and 0 < labels[r].mean() < 1 else np.arange(len(labels)) for r in rows]

    def taken(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.concatenate([[0], np.cumsum([len(a[i]) for i in r])]).astype(np.int64)
        empty = np.zeros(0, np.int32)
        return np.concatenate([a[i] for i in r] or [empty]), np.concatenate([b[i] for i in r] or [empty]), first

    word = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    head = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    odds = [log_odds([d[i] for i in rows[0]], labels[rows[0]]) for d in (a, b)]
    for table, o in zip((word, head), odds):
        table[o == 0] = 0
        table[:, 0] = o / 2
    model = Model(word, head)
    for width in WIDTHS:
        tap = rng.normal(0, 0.1, (width, 2 * DIM, FILTERS)).astype(np.float32)
        tap[:, 0] += 1.0 / width
        tap[:, DIM] += 1.0 / width
        model.taps.append(tap)
        model.bias.append(np.full(FILTERS, -0.5, np.float32))
    model.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
    model.out_bias = -2.0

    state: dict = {}
    t = 0
    bias_out = np.array([model.out_bias])
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))  # both kinds count alike
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(rows[1]), max(1, len(rows[1]) // BATCH)):
            t += 1
            wa, wb, first = taken(batch)
            if not len(wa):
                continue
            features, where, x = model.pooled(wa, wb, first, places=True)
            p = sigmoid(features @ model.out + bias_out[0])
            g = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            back = g[:, None] * model.out * (features > 0)
            _adam(state, "out", model.out, features.T @ g + 1e-3 * model.out, 0.02, t)
            _adam(state, "out_bias", bias_out, np.array([g.sum()]), 0.02, t)
            for k, width in enumerate(WIDTHS):
                tap_grad = np.zeros_like(model.taps[k])
                bias_grad = back[:, k * FILTERS:(k + 1) * FILTERS].sum(axis=0)
                for f in range(FILTERS):
                    c = k * FILTERS + f
                    r = np.flatnonzero((where[:, c] >= 0) & (back[:, c] != 0))
                    for j in range(width):
                        at = where[r, c] + j
                        ok = at < first[r + 1]
                        d = back[r[ok], c][:, None]
                        tap_grad[j, :, f] += (d * x[at[ok]]).sum(axis=0)
                        step = 0.5 * d * model.taps[k][j, :, f]
                        known_a, known_b = odds[0][wa[at[ok]]] != 0, odds[1][wb[at[ok]]] != 0
                        np.subtract.at(model.word, wa[at[ok]][known_a], step[known_a, :DIM])
                        np.subtract.at(model.head, wb[at[ok]][known_b], step[known_b, DIM:])
                _adam(state, f"tap{k}", model.taps[k], tap_grad, 0.01, t)
                _adam(state, f"bias{k}", model.bias[k], bias_grad, 0.01, t)
    model.out_bias = float(bias_out[0])
    calibrate(model, *taken(rows[2]), labels[rows[2]], [langs[i] for i in rows[2]])
    return model


def calibrate(model: Model, a: np.ndarray, b: np.ndarray, first: np.ndarray, labels: np.ndarray, langs: list) -> None:
    """Logistic calibration (Newton steps, a small ridge), then thresholds."""
    z = model.logit(a, b, first)
    # smoothed targets keep the fit finite where the two kinds do not overlap
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(design @ beta)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hess, design.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        if not np.all(np.isfinite(beta)) or beta[0] <= 0:
            beta = np.array([1.0, 0.0])
            break
    model.slope, model.shift = float(beta[0]), float(beta[1])
    scores = sigmoid(design @ beta)
    model.threshold = best_threshold(scores, labels)
    langs_of = np.array([x if x is not None else "" for x in langs], dtype=object)
    for lang in sorted(set(langs_of.tolist()) - {""}):
        own = langs_of == lang
        if own.sum() >= MIN_LANGUAGE and 0 < labels[own].mean() < 1:
            model.by_language[lang] = best_threshold(scores[own], labels[own])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best-F1 gap between two scores."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores are not told apart
    best = int(np.argmax(f1))
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def gather(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int = MAX_TRAIN):
    """The bounded training sample as (a, b, labels, langs) on the driver.

    ``labels`` has ``doc_id`` and the label; ``allowed`` filters it.
    """
    spark = docs.sparkSession
    known = (labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # narrow rows: an id and a label
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"), lang.alias("lang")).filter(
        F.length("text") <= MAX_TRAIN_CHARS)
    # a repeated id counts by one of its rows, so the sample has `limit` rows at most
    sample = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
              .agg(F.min_by(F.struct("text", "lang", "_label"), F.struct(F.xxhash64("text"), "text", "lang")).alias("r"))
              .select("doc_id", "r.text", "r.lang", "r._label"))
    bounded_batches(spark)
    rows = sample.mapInArrow(_buckets, "doc_id bigint, lang string, label int, a binary, b binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    unpack = lambda column: [np.frombuffer(x, dtype=np.int32) for x in column]
    return unpack(rows["a"]), unpack(rows["b"]), rows["label"].to_numpy(), rows["lang"].tolist()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for _, data, offsets in chunks(*buffers(batch.column(1))):
            w = words(data, offsets)
            x, y = buckets_of(w)
            for s, e in zip(w.row_first[:-1], w.row_first[1:]):
                a.append(x[s:e].tobytes())
                b.append(y[s:e].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.string()), batch.column(3), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
            names=["doc_id", "lang", "label", "a", "b"])


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in chunks(*buffers(batch.column(1)), limit=1 << 18):
                w = words(data, offsets)
                parts.append(model.score(*buckets_of(w), w.row_first))
            score = np.concatenate(parts) if parts else np.zeros(0)
            langs = batch.column(2).to_pylist()
            threshold = np.array([model.by_language.get(x, model.threshold) for x in langs], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(threshold), pa.array(score >= threshold)],
                names=["row", "score", "threshold", "rejected"])

    return run


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default), ``score``, ``threshold`` and ``rejected``."""
    bounded_batches(docs.sparkSession)
    names = docs.columns if keep is None else keep
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    ready = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), text_of(docs).alias("text"), lang.alias("lang"))
    schema = T.StructType([ready.schema["row"], T.StructField("score", T.DoubleType()),
                           T.StructField("threshold", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return ready.mapInArrow(_scored(model), schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on rows of ``labels`` outside the held-out third."""
    return train(*gather(docs, labels, "toxic", ~held_out(F.col("doc_id"), 3, 1)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected`` for every row of ``docs``."""
    scored = score_documents(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select(
        "row.doc_id", held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "rejected")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return score_documents(docs, fit(docs, labels)).filter(~F.col("rejected")).select("row.*")
