"""Stream over daily files equals one batch run; replaying the files adds nothing; failed batches leave no trace."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from leadforge.plans import ingest
from leadforge.plans.queries import PIPELINE_DOMAINS, RUN2_TS
from leadforge.operators import upsert
from leadforge.session import scratch_path
from leadforge.sources.tables import messages
from leadforge.streaming import ingest_stream as S
from leadforge.streaming import tiers as T


def test_stream_equals_batch_and_replay_is_empty(spark):
    base = scratch_path(spark, "t-stream")
    drop, state = f"{base}/drop", f"{base}/state"
    msgs = messages(spark, SF_SMALL)
    S.write_mail_drop(msgs, drop)
    schema = spark.read.parquet(drop).schema
    cfg = ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN2_TS)
    S.start_ingest(spark, drop, state, f"{base}/ck1", schema, cfg, files_per_trigger=80, epoch=1).awaitTermination()
    batch = ingest.run(msgs, ingest.empty_ledger(spark), upsert.empty_contacts(spark), cfg)
    streamed = spark.read.parquet(f"{state}/outcomes").select("seq", "outcome")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.outcomes.select("seq", "outcome").collect()))
    n_ledger = spark.read.parquet(f"{state}/ledger").count()
    S.start_ingest(spark, drop, state, f"{base}/ck2", schema, cfg, files_per_trigger=80, epoch=2).awaitTermination()
    assert spark.read.parquet(f"{state}/ledger").count() == n_ledger
    replay = spark.read.parquet(f"{state}/outcomes").filter(F.col("batch_id") >= 2 * S.EPOCH_SPAN)
    assert replay.filter(F.col("outcome") != "duplicate").count() == 0


CFG = ingest.RunConfig(allowed_domains=PIPELINE_DOMAINS, run_ts=RUN2_TS)


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_failed_batch_is_invisible_and_its_replay_completes_the_state(spark, monkeypatch):
    base = scratch_path(spark, "t-replay")
    state = f"{base}/state"
    msgs = messages(spark, SF_SMALL).filter("seq < 120").checkpoint()
    batches = [msgs.filter(F.col("seq").between(i * 40, i * 40 + 39)) for i in range(3)]

    def follow():
        S.start_contact_state(spark, state, f"{base}/parts", f"{base}/ck_state").awaitTermination()
        S.start_live_totals(spark, state, f"{base}/totals", f"{base}/ck_totals").awaitTermination()

    S.process_batch(batches[0], 0, state, CFG, fan=2, buckets=4)
    before = _rows(S.read_state(spark, state, "contacts"))
    calls, newest = [], S._newest

    def failing(rows):  # the second call of this batch merges the runs, after all other outputs
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return newest(rows)

    monkeypatch.setattr(S, "_newest", failing)
    with pytest.raises(RuntimeError):
        S.process_batch(batches[1], 1, state, CFG, fan=2, buckets=4)
    monkeypatch.undo()
    follow()
    assert _rows(S.read_state(spark, state, "contacts")) == before
    first = spark.read.parquet(f"{state}/outcomes/batch_id={S.EPOCH_SPAN}")
    assert _rows(S.read_live_totals(spark, f"{base}/totals")) == _rows(S.live_totals(first))

    S.process_batch(batches[1], 1, state, CFG, fan=2, buckets=4)
    S.process_batch(batches[1], 1, state, CFG, fan=2, buckets=4)  # a batch that comes twice
    S.process_batch(batches[2], 2, state, CFG, fan=2, buckets=4)  # reads the merged run of batch 1
    follow()
    whole = ingest.run(msgs, ingest.empty_ledger(spark), upsert.empty_contacts(spark), CFG)
    assert _rows(S.read_state(spark, state, "contacts")) == _rows(whole.contacts)
    assert _rows(S.read_live_totals(spark, f"{base}/totals")) == _rows(S.live_totals(whole.outcomes))
    cols = ["email", "first_name", "last_name", "phone", "org", "last_message_subject", "last_message_received_at",
            "last_message_excerpt"]
    assert _rows(S.read_contact_state(spark, f"{base}/parts").select(*cols)) == _rows(whole.contacts.select(*cols))


def test_unreadable_state_stops_the_run(spark):
    state = scratch_path(spark, "t-broken")
    folder = f"{state.removeprefix('file:')}/commits/batch_id={S.EPOCH_SPAN}"
    os.makedirs(folder)
    with open(f"{folder}/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        S.process_batch(messages(spark, SF_SMALL).limit(5), 1, state, CFG)
    assert not os.path.exists(f"{state}/outcomes")


def test_runs_stay_few_and_lose_no_batch():
    """200 batches: fewer than ``fan`` runs a level, every batch in exactly one run, each rewritten once a level."""
    holds, live, rewrites = {}, [], {}
    for b in range(200):
        earlier, (live, merged) = live, T.add_run(live, b, 4)
        holds[f"0-{b}"] = {b}
        if merged:
            holds[live[-1]] = set().union(*[holds[r] for r in merged])
            assert set(merged) <= {*earlier, f"0-{b}"}
            for x in holds[live[-1]]:
                rewrites[x] = rewrites.get(x, 0) + 1
        assert sorted(x for r in live for x in holds[r]) == list(range(b + 1))
        assert all(sum(T.level_of(r) == n for r in live) < 4 for n in range(6)) and len(live) <= 3 * 4
    assert max(rewrites.values()) <= 4


def test_ledger_lookup_equals_the_whole_ledger_without_its_exchange(spark):
    path = scratch_path(spark, "t-keys")
    keys = S.key_tiers(spark, path, fan=3, buckets=4)
    held, runs = set(), []
    for b in range(1, 12):
        new = [f"m<{(b * 37 + i * 11) % 97}@x>" for i in range(9)] + [f"u{b}"]
        runs = keys.put(spark.createDataFrame([(k,) for k in {*new}], "key string"), b, runs)
        held |= {*new}
    assert max(map(T.level_of, runs)) == 2
    asked = spark.createDataFrame([(f" <{i}@x> ", f"{i}", i) for i in range(40)] + [(None, "3", 50), (None, None, 51), ("", "99", 52)],
                                  "message_id string, imap_uid string, seq long")
    got = {("m" + r["message_id"]) if r["message_id"] else "u" + r["imap_uid"] for r in S.known_keys(asked, keys, runs).collect()}
    want = {f"m<{i}@x>" for i in range(40)} | {f"u{i}" for i in range(40)} | {"u99"}
    assert got == held & want
    for r in runs:  # a catalog that lacks the tables finds them again
        spark.sql(f"DROP TABLE IF EXISTS {keys._table(r)}")
    assert {r["key"] for r in keys.read(runs).collect()} == held
    run = keys.run(max(runs, key=T.level_of))
    many = spark.range(1000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("key")).hint("merge")
    plan = run.join(many, "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    state_side = plan[:plan.index("Range")]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in state_side


def test_live_runs_are_those_of_the_commit_before(spark):
    state = scratch_path(spark, "t-commits")
    assert S.live_runs(spark, state) == []
    for b, runs in ((7, ["0-7"]), (8, ["0-7", "0-8"]), (20, None)):
        spark.createDataFrame([(True, runs)], "committed boolean, runs array<string>").write.parquet(f"{state}/commits/batch_id={b}")
    assert [S.live_runs(spark, state, before=b) for b in (7, 8, 9, 15)] == [[], ["0-7"], ["0-7", "0-8"], ["0-7", "0-8"]]
    for before in (21, 30, None):  # a commit without runs is no empty state
        with pytest.raises(ValueError):
            S.live_runs(spark, state, before=before)


def test_contact_parts_merge_in_any_order(spark):
    rows = spark.createDataFrame(
        [("a", i, None if i == 0 else f"n{i}", "", None, None, None if i == 3 else f"s{i}", None, None if i == 3 else "x")
         for i in range(4)] * 2,
        "email string, seq long, first_name string, last_name string, phone string, org string, subject string, "
        "received_at timestamp, excerpt string")
    parts = [S.contact_parts(rows.filter(c)) for c in ("seq % 2 = 0", "seq % 2 = 1")]
    want = S.contact_parts(rows).collect()
    assert want[0]["first_name"]["value"] == "n1" and want[0]["last_name"] is None
    assert want[0]["subject"]["value"] == "s2" and want[0]["excerpt"]["value"] is None and want[0]["received_at"] is None
    assert S.merge_parts(parts[0].unionByName(parts[1])).collect() == want
    assert S.merge_parts(parts[1].unionByName(parts[0]).unionByName(parts[1])).collect() == want


def test_watermark_dedup_forgets_what_lies_behind_its_horizon(spark, tmp_path):
    """A repeat within the horizon goes, one behind it stays: the watermark moved and evicted the key."""
    import datetime as dt
    import os

    from pyspark.sql import functions as F

    from leadforge.streaming import ingest_stream as S
    drop, schema = tmp_path / "drop", "message_id string, imap_uid string, at timestamp"
    days = [(1, "<early@x>"), (2, "<early@x>"), (10, "<b@x>"), (20, "<c@x>"), (21, "<early@x>"), (22, "<c@x>"), (40, "<d@x>")]
    for i, (day, mid) in enumerate(days):  # one file, so one trigger, a day
        row = [(mid, None, dt.datetime(2024, 1, 1) + dt.timedelta(days=day))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(drop))
        newest = max((p for p in drop.glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(drop))
    q = (S.dedup_within_watermark(src, "at", "3 days").writeStream.option("checkpointLocation", str(tmp_path / "ckpt"))
         .format("parquet").option("path", str(tmp_path / "kept")).trigger(availableNow=True).start())
    q.awaitTermination()
    kept = spark.read.schema(schema).parquet(str(tmp_path / "kept")).groupBy("message_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r["message_id"]: r["n"] for r in kept.collect()} == {"<early@x>": 2, "<b@x>": 1, "<c@x>": 1, "<d@x>": 1}
    assert q.lastProgress.stateOperators[0].numRowsTotal < len(days) - 2
