"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are compared by their sets of five-word shingles; two are linked at a
Jaccard similarity of ``THRESHOLD`` or more.

1. One pass over the whole texts gives each document a digest of its shingle
   set and, for each of ``TREES`` tries, the path of ``LEVELS`` MinHash values as
   one number whose leading bits are its prefixes, so that sorting it sorts
   the trie. Documents with equal sets form one *class* from here on.
2. Matched prefixes start at full length and are shortened until a pair at the
   threshold meets in some trie with the target recall (:func:`prefix_levels`).
   Classes that share a prefix are tied to the least class there.
3. Connected components of these ties hold all candidate pairs. The texts of
   their classes alone are shuffled, once; a component of more than ``BLOCK``
   classes is dealt into blocks and every pair of blocks is a group of its own,
   so no task ever holds more than two blocks.
4. In a group all intersections come from one product of the incidence matrix
   of shingles (equal columns merged). Links are counted, and the group hands
   on a spanning forest instead of its links.
5. Components of the forests are the near-duplicate groups.

Result, one row per row of ``docs``: ``doc_id``; ``class_id``, the least id of
its near-duplicate group; ``copy_of``, the least id with the same shingle set;
``n_copies``, rows with that set; ``n_links``, different texts linked to it.

Defined cases: a text of fewer than five words has one shingle, of all its
words; null texts and texts without words are linked to nothing, not even to
each other (``class_id`` and ``copy_of`` are their own id); repeated rows are
copies; a null id is kept and is never the least unless all are null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .components import connected
from .keep import drop_losers
from .tables import bounded_batches, materialise, text_of
from .text import buffers, chunks, distinct_by_row, mix, shingle_hashes, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9995
TREES = 16
LEVELS = 5
BITS = 12       # of each level of a path
BLOCK = 256     # classes compared at once, against as many others

PATHS = [f"path{t}" for t in range(TREES)]
_RANDOM = np.random.default_rng(17).integers(0, 1 << 63, size=(2, TREES * LEVELS), dtype=np.uint64)
_FLIP, _FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def prefix_levels(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with the target recall."""
    for d in range(levels, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= target:
            return d
    raise ValueError("more tries are needed for this recall")


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, row), by row."""
    w = words(data, offsets)
    return distinct_by_row(*shingle_hashes(word_hashes(w), w.row_first, SHINGLE))


def digests(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that do not depend on the order of the set."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + count.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def paths(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x TREES: paths of MinHash values; rows without shingles are zero."""
    result = np.zeros((rows, TREES), dtype=np.uint64)
    if not len(value):
        return result.view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    full = row[first]
    mask = np.uint64((1 << BITS) - 1)
    scratch = np.empty_like(value)
    for k in range(TREES * LEVELS):
        np.bitwise_xor(value, _FLIP[k], out=scratch)
        np.multiply(scratch, _FACTOR[k], out=scratch)
        least = mix(np.minimum.reduceat(scratch, first)) & mask
        tree, level = divmod(k, LEVELS)
        result[full, tree] |= least << np.uint64(BITS * (LEVELS - 1 - level))
    return result.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in chunks(*buffers(batch.column(1)), limit=1 << 19):
            rows = len(offsets) - 1
            value, row = shingle_sets(data, offsets)
            node, check = digests(value, row, rows)
            keys = paths(value, row, rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, rows), pa.array(np.bincount(row, minlength=rows).astype(np.int64)),
                pa.array(node), pa.array(check), *[pa.array(keys[:, t]) for t in range(TREES)],
            ], names=["doc_id", "n", "node", "check", *PATHS])


def _linked(threshold: float):
    """Rows sorted by group ``(comp, lo, hi)`` to ``(node, root, links)``, a row for each node of a group."""

    def solve(nodes: list[int], texts: list[str], blocks: list[int], lo: int, hi: int) -> pa.RecordBatch:
        data, offsets = buffers(pa.array(texts, pa.large_string()))
        value, row = shingle_sets(data, offsets)
        size = len(nodes)
        count = np.bincount(row, minlength=size).astype(np.float64)
        _, column, frequency = np.unique(value, return_inverse=True, return_counts=True)
        shared = frequency[column] > 1
        column, row = column[shared], row[shared]
        # shingles held by the same rows are one column with a weight
        pattern = np.zeros(len(frequency), dtype=np.uint64)
        np.add.at(pattern, column, mix(row.astype(np.uint64) + np.uint64(1)))
        kinds, kind, weight = np.unique(pattern[np.unique(column)], return_inverse=True, return_counts=True)
        of_column = np.zeros(len(frequency), dtype=np.int64)
        of_column[np.unique(column)] = kind
        common = np.zeros((size, size))
        width = 4096
        for at in range(0, len(kinds), width):
            part = (of_column[column] >= at) & (of_column[column] < at + width)
            incidence = np.zeros((size, min(width, len(kinds) - at)), dtype=np.float32)
            incidence[row[part], of_column[column[part]] - at] = 1
            common += (incidence * weight[at:at + width].astype(np.float32)) @ incidence.T
        linked = common >= threshold * (count[:, None] + count[None, :] - common) - 1e-6
        linked &= common > 0
        np.fill_diagonal(linked, False)
        if lo != hi:
            side = np.array(blocks)
            linked &= side[:, None] != side[None, :]
        label = np.arange(size)
        while True:
            reach = np.where(linked, label[None, :], size).min(axis=1, initial=size)
            new = np.minimum(label, reach)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        ids = np.array(nodes, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ids[label]), pa.array(linked.sum(axis=1).astype(np.int64))], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts, blocks = None, [], [], []
        for batch in batches:
            for comp, lo, hi, node, block, text in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if (comp, lo, hi) != key:
                    if nodes:
                        yield solve(nodes, texts, blocks, *key[1:])
                    key, nodes, texts, blocks = (comp, lo, hi), [], [], []
                nodes.append(node)
                texts.append(text)
                blocks.append(block)
        if nodes:
            yield solve(nodes, texts, blocks, *key[1:])

    return run


def links(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``docs``; see the module text."""
    return _links(docs, threshold, target).select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def _links(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    """:func:`links` with each row's class ``(node, check)`` and ``keeper``, the node of the class that stays of its group."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    signed = materialise(
        narrow.mapInArrow(
            _signatures, "doc_id bigint, n bigint, node bigint, check bigint, " + ", ".join(f"{p} bigint" for p in PATHS)),
        "signatures")
    with_words = signed.filter("n > 0")
    classes = materialise(
        with_words.groupBy("node", "check").agg(
            F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), *[F.min(p).alias(p) for p in PATHS]), "classes")

    # ties between classes that share a prefix in some trie
    shift = BITS * (LEVELS - prefix_levels(threshold, target))
    prefixes = classes.select("node", F.posexplode(F.array(*PATHS)).alias("tree", "path")).select(
        "node", F.xxhash64("tree", F.shiftright("path", shift)).alias("prefix"))
    shared = materialise(
        prefixes.groupBy("prefix").agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .filter("least <> most").select("prefix", "least"), "prefixes")
    ties = prefixes.join(shared, "prefix").select("node", "least")
    candidates = materialise(
        connected(ties, "node", "least").join(classes.select("node", "copy_of"), "node"), "candidates")

    # deal the components into blocks and the blocks into pairs
    sizes = materialise(
        candidates.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select(
            "root", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "component-sizes")
    members = materialise(candidates.join(sizes, "root").select(
        "node", "copy_of", F.col("root").alias("comp"), "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "candidate-members")
    known = members.count()
    hit = bloom.possible(narrow, F.col("doc_id"), members, F.col("copy_of"), known).filter("_possible").drop("_possible")
    texts = hit.join(members, hit["doc_id"].eqNullSafe(members["copy_of"])).select("node", "comp", "blocks", "block", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # an id may stand for several rows: those whose text is not the class's go, of equal ones one stays
    own = texts.mapInArrow(_own_texts, texts.schema).dropDuplicates(["node"])
    grouped = (own.select("comp", "node", "block", "text", other)
               .select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "text")
               .repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "node"))
    found = materialise(grouped.mapInArrow(_linked(threshold), "node bigint, root bigint, links bigint"), "links")
    groups = materialise(
        connected(found.select("node", "root"), "node", "root").join(members.select("node", "copy_of"), "node"), "groups")
    # several classes of a group can have its least id, or none an id: the least node of these is kept
    least = materialise(
        groups.groupBy("root").agg(
            F.min("copy_of").alias("class_id"),
            F.min(F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "node")).alias("first")).select(
            "root", "class_id", F.col("first.node").alias("keeper")), "group-ids")
    grouped = groups.join(least, "root").join(found.groupBy("node").agg(F.sum("links").alias("n_links")), "node")
    labelled = materialise(
        classes.select("node", "check", "copy_of", "n_copies").join(grouped.select("node", "class_id", "keeper", "n_links"), "node", "left").select(
            "node", "check", "copy_of", "n_copies", F.coalesce("class_id", "copy_of").alias("class_id"),
            F.coalesce("keeper", "node").alias("keeper"),
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")), "class-labels")
    rows = signed.select("doc_id", "n", "node", "check")
    with_class = rows.filter("n > 0").join(labelled, ["node", "check"]).select(
        "doc_id", "class_id", "copy_of", "n_copies", "n_links", "node", "check", "keeper")
    without = rows.filter("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
        F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"),
        "node", "check", F.col("node").alias("keeper"))
    return with_class.unionByName(without)


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        nodes = np.asarray(batch.column(0))
        for lo, data, offsets in chunks(*buffers(batch.column(4))):
            value, row = shingle_sets(data, offsets)
            keep[lo:lo + len(offsets) - 1] = digests(value, row, len(offsets) - 1)[0] == nodes[lo:lo + len(offsets) - 1]
        yield batch.filter(pa.array(keep))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, row) with the class ``(node, check)`` of the text."""
    for batch in batches:
        node, check = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        for lo, data, offsets in chunks(*buffers(batch.column(1))):
            rows = len(offsets) - 1
            node[lo:lo + rows], check[lo:lo + rows] = digests(*shingle_sets(data, offsets), rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(check)], names=["id", "text", "row", "node", "check"])


def _with_classes(rows: DataFrame) -> DataFrame:
    schema = T.StructType([*rows.schema, T.StructField("node", T.LongType()), T.StructField("check", T.LongType())])
    return rows.mapInArrow(_classes, schema)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Of each near-duplicate group of ``docs`` the row with the least id, with its own columns.

    Only rows whose group has others are shuffled; of repeated rows one stays. Of
    texts of one group with the same id (or all without) one stays.
    """
    joined = _links(docs, threshold, target)
    decided = materialise(joined.filter((F.col("n_links") > 0) | (F.col("n_copies") > 1)), "near-duplicates")
    stays = F.col("doc_id").eqNullSafe(F.col("copy_of")) & (F.col("node") == F.col("keeper"))
    return drop_losers(docs, decided.groupBy("doc_id", "node", "check").agg(F.max(stays).alias("stays")), _with_classes)
