"""Substring dedup, suffix dedup and the n-gram join against brute force."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from leadforge.llm import components, ngram_join, substring_dedup, suffix_dedup
from leadforge.llm.text import buffers

from .conftest import ODD, prose

PASSAGE = prose(77, 60)


def corpus():
    near = prose(5, 200).split()
    rows = [*ODD, (7, prose(7, 4000)), (100, prose(100, 150)), (101, prose(100, 150)), (102, "x" + prose(100, 150)),
            (103, prose(9, 40) + " " + PASSAGE + " " + prose(10, 40)), (104, PASSAGE), (105, prose(11, 70) + PASSAGE[3:]),
            (106, "ab" * 400), (107, "ab" * 60), (108, prose(12, 90) + prose(12, 90)), (109, "é" * 120 + "x"), (110, "é" * 130)]
    rows += [(200 + k, " ".join(near[:k * 3] + ["edit%d" % k] + near[k * 3 + 1:])) for k in range(30)]
    return rows


def brute_suffix(rows):
    seen, out = set(), {}
    for i, text in sorted(((r[0] if r[0] is not None else -1, r[1]) for r in set(rows)), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\x01" * 100
            seen.add(b[p:p + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(b)) if gone[q] and not (q and gone[q - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_is_exact(docs_of, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus()
    want = brute_suffix(rows)
    got = suffix_dedup.dedup_suffixes(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[-1 if r["doc_id"] is None else r["doc_id"]], r["doc_id"]


def contexts_of(texts):
    """All contexts of the texts (ids from 0 on) as `_by_suffix_array` takes them: sorted by anchor."""
    places = pa.Table.from_batches(suffix_dedup._anchors(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])))
    rows = [(r["doc_id"], r["anchor"], r["place"], r["before"], r["after"],
             texts[r["doc_id"]].encode()[r["place"] - r["before"]:r["place"] + r["after"]]) for r in places.to_pylist()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*sorted(rows, key=lambda r: (r[1], r[0], r[2]))), [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.binary()])], list("dapbfr"))


def sorted_symbols(monkeypatch):
    seen, sort = [], suffix_dedup.joint_suffix_array
    monkeypatch.setattr(suffix_dedup, "joint_suffix_array", lambda s: (seen.extend(s), sort(s))[1])
    return seen


def test_suffix_array_gets_only_symbols_that_may_lie_in_a_shared_core(monkeypatch):
    line = prose(61, 9)[:60]      # shorter than LENGTH: equal anchors, no equal strings
    texts = [prose(300 + k, 30) + line + prose(400 + k, 30) for k in range(40)]
    seen = sorted_symbols(monkeypatch)
    assert sum(b.num_rows for b in suffix_dedup._by_suffix_array(contexts_of(texts).to_batches())) == 0 and not seen
    texts = [prose(300 + k, 30) + prose(62, 40) + prose(400 + k, 30) for k in range(40)]
    assert sum(b.num_rows for b in suffix_dedup._by_suffix_array(contexts_of(texts).to_batches())) >= 39 and seen


def test_suffix_arrays_do_not_depend_on_batches(monkeypatch):
    table = contexts_of([(t or "") for _, t in corpus()])

    def gone():
        spans = [s for b in suffix_dedup._by_suffix_array(iter(table.to_batches(max_chunksize=size))) for s in b.to_pylist()]
        return {(s["doc_id"], p) for s in spans for p in range(s["start"], s["start"] + s["length"])}

    size = 10_000
    want = gone()
    assert want
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 10)
    for size in (1, 7, 64):
        assert gone() == want


def test_kept_bytes_of_overlapping_touching_and_null_spans():
    texts = ["a" * 10 + "b" * 10, "", None, "é" * 8, "z" * 5]
    spans = [[(0, 4), (2, 4), (6, 2), (15, 5)], [], None, [(0, 16)], None]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    batch = pa.record_batch([pa.array([0, 1, 2, 3, None]), pa.array(texts), pa.array(
        [None if x is None else [{"start": s, "length": n} for s, n in x] for x in spans], kind)], ["doc_id", "text", "spans"])
    got = [tuple(r.values()) for b in suffix_dedup._kept(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    digest = [hashlib.sha256(x).hexdigest() for x in (b"aabbbbb", b"", b"", b"", b"zzzzz")]
    assert got == [(0, 20, 13, 2, digest[0]), (1, 0, 0, 0, digest[1]), (2, 0, 0, 0, digest[2]), (3, 16, 16, 1, digest[3]), (None, 5, 0, 0, digest[4])]


def windows_of(b, ends):
    """(start, end) of all shortest runs of chunks that reach MIN_RUN bytes, from each chunk onwards and up to each chunk."""
    chunk = list(zip([0, *ends[:-1]], ends))
    out = set()
    for i, (s, _) in enumerate(chunk):
        out |= {(s, next((e for _, e in chunk[i:] if e - s >= substring_dedup.MIN_RUN), None))}
    for j, (_, e) in enumerate(chunk):
        out |= {(next((s for s, _ in reversed(chunk[:j + 1]) if e - s >= substring_dedup.MIN_RUN), None), e)}
    return sorted(w for w in out if None not in w)


def test_substring_dedup_matches_sequential_chunks(docs_of):
    rows = corpus()
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs_of(rows)).collect()}
    seen: dict[tuple, tuple] = {}
    for i, text in sorted(((r[0] if r[0] is not None else -1, r[1]) for r in set(rows)), key=lambda r: r[0]):
        b = (text or "").encode()
        ends = substring_dedup.cut_places(*buffers(pa.array([text]))).tolist()
        gone = bytearray(len(b))
        for s, e in windows_of(b, ends):
            inner = tuple(x - s for x in ends if s < x <= e)  # equal bytes cut alike
            if seen.setdefault((b[s:e], inner), (i, s)) != (i, s):
                gone[s:e] = b"\x01" * (e - s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        r = got[None if i == -1 else i]
        assert (r["n_bytes"], r["n_chunks"], r["n_removed"], r["kept_sha256"]) == (
            len(b), len(ends), sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert got[101]["n_removed"] > 0 and got[104]["n_removed"] > 0 and got[7]["n_removed"] == 0


def repeated_bytes(rows):
    """For each id, which bytes lie in a string of 100 bytes that stands earlier."""
    seen, out = set(), {}
    for i, text in sorted(((r[0] if r[0] is not None else -1, r[1]) for r in set(rows)), key=lambda r: r[0]):
        b = (text or "").encode()
        out[i] = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                out[i][p:p + 100] = b"\x01" * 100
            seen.add(b[p:p + 100])
    return out


def test_substring_dedup_removes_repeated_strings_only(docs_of):
    phrases = [prose(3000 + k, 5) for k in range(60)]
    mixed = [(1000 + k, " ".join(sorted(phrases, key=lambda p: hashlib.md5(f"{k}{p}".encode()).digest()))) for k in range(40)]
    rows = [*corpus(), *mixed, (2000, prose(60, 30) + mixed[3][1][:400] + prose(61, 30))]
    repeated = repeated_bytes(rows)
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs_of(rows)).collect()}
    for i, r in got.items():
        assert all(all(repeated[i][s["start"]:s["start"] + s["length"]]) for s in r["spans"]), i
    clean = [i for i, _ in mixed if not any(repeated[i])]
    assert len(clean) > 15 and all(got[i]["n_removed"] == 0 for i in clean)
    assert got[2000]["n_removed"] >= 300 and got[101]["n_removed"] == got[101]["n_bytes"]


def test_cuts_resist_insertions():
    text = prose(50, 800)
    ends = set(substring_dedup.cut_places(*buffers(pa.array([text]))).tolist())
    moved = {e - 5 for e in substring_dedup.cut_places(*buffers(pa.array(["12345" + text]))).tolist()}
    assert len(ends - moved) <= 3


def brute_join(rows):
    sets = {}
    for i, t in rows:
        value, _ = ngram_join.shingle_sets(*buffers(pa.array([t])))
        sets[i, t] = frozenset(value.tolist())
    classes = defaultdict(list)
    for i, t in rows:
        if sets[i, t]:
            classes[sets[i, t]].append(i)
    kinds = list(classes)
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(kinds)
    for a in range(len(kinds)):
        for b in range(a + 1, len(kinds)):
            if len(kinds[a] & kinds[b]) >= 0.8 * len(kinds[a] | kinds[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {k: min((x for x in ids if x is not None), default=None) for k, ids in classes.items()}
    group = {}
    for k, s in enumerate(kinds):
        if least[s] is not None:
            group[find(k)] = min(group.get(find(k), least[s]), least[s])
    out = []
    for i, t in rows:
        s = sets[i, t]
        k = kinds.index(s) if s else None
        out.append((i, group.get(find(k), least[s]), least[s], len(classes[s]), links[k]) if s else (i, i, i, 1, 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 7])
def test_ngram_join_matches_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    got = [tuple(r[c] for c in ("doc_id", "class_id", "copy_of", "n_copies", "n_links")) for r in ngram_join.links(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_join(rows)


def test_keep_one_keeps_the_least_of_each_group(docs_of):
    docs = docs_of(corpus())
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 100 in ids and 101 not in ids and 102 not in ids and 200 in ids and not any(201 <= (i or 0) < 230 for i in ids)
    assert ids.count(4) == 1 and {1, 2, 3, 7, 104} <= set(ids)


def test_keep_one_decides_by_id_and_text(docs_of):
    """Null and repeated ids, of which only some texts are copies."""
    near, other, alone = prose(40, 80), prose(41, 80), prose(43, 80)
    rows = [(1, near), (None, near + " tail"), (None, prose(42, 80)), (None, near), (5, near + " end"), (5, prose(44, 80)),
            (None, other), (None, other + " tail"), (8, alone), (8, alone + " tail"), (8, prose(45, 80))]
    left = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs_of(rows)).collect()), key=str)
    assert sum(t in (other, other + " tail") for _, t in left) == 1 and sum(t in (alone, alone + " tail") for _, t in left) == 1
    rest = [x for x in left if x[1].removesuffix(" tail") not in (other, alone)]
    assert rest == sorted([(1, near), (None, prose(42, 80)), (5, prose(44, 80)), (8, prose(45, 80))], key=str)


def test_empty_tables(empty):
    assert ngram_join.links(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 400), (400, 500)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[500] == 400
