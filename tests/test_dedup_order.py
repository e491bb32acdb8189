"""In-batch dedup (F3) against the message-by-message loop, and connected components."""

import random
import time

import pytest

from leadforge.functions.components import connected
from leadforge.operators import routing

SCHEMA = "seq long, message_id string, imap_uid string"


def one_by_one(rows):
    mids, uids, out = set(), set(), {}
    for seq, mid, uid in sorted(rows):
        mid = (mid or "").strip() or None
        out[seq] = (mid is not None and mid in mids) or (uid is not None and uid in uids)
        if not out[seq]:
            mids.add(mid)
            uids.add(uid)
    return out


def flags(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["seq"]: r["duplicate"] for r in routing.duplicate_flags(df).collect()}


def chain(n, start=0):
    """Each row shares its id with the row before and its uid with the row after it."""
    return [(start + i, f"m{start}-{i // 2}", f"u{start}-{(i + 1) // 2}") for i in range(n)]


@pytest.mark.parametrize("limit", [routing.MAX_COMPONENT, 3])
def test_conflicting_keys_follow_message_order(spark, monkeypatch, limit):
    """With a small limit the larger components go on in rounds."""
    monkeypatch.setattr(routing, "MAX_COMPONENT", limit)
    rng = random.Random(limit)
    rows = chain(9) + chain(4, 100) + [(200 + i, "hot", f"h{i % 3}") for i in range(40)]
    rows += [(300 + i, rng.choice([None, "", *[f"a{k}" for k in range(9)]]), rng.choice([None, *[f"b{k}" for k in range(9)]])) for i in range(40)]
    assert flags(spark, rows) == one_by_one(rows)


def test_a_long_chain_takes_few_jobs(spark):
    rows = chain(3000)
    begun = time.time()
    assert flags(spark, rows) == one_by_one(rows)
    assert time.time() - begun < 120


def test_components_equal_a_plain_search(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)] + [("x", "x")]
    edges += [(f"p{i:03}", f"p{i + 1:03}") for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in list(parent)}
