"""Structured Streaming forms of the ingestion run.

T1  ``start_ingest``: new mail files -> ``foreachBatch`` runs the batch plan
    (``plans.ingest.run``) against the ledger and contacts kept under a state
    folder. Every micro-batch writes its outputs under ``batch_id=<n>`` and
    overwrites that folder if the batch is replayed after a failure, then
    records the id in ``commits``; readers join with ``commits``, so ledger,
    events and contacts stay consistent (exactly once per batch id). Ledger keys
    and contacts are also kept in tiers (``streaming.tiers``): a micro-batch writes
    its own keys and changed contacts, looks its keys up in a few bucketed runs
    and names the live runs in its commit.
T2  ``start_contact_state``: contact state per email. The stream reads
    ``commits``, so it sees committed batches only; a batch is reduced to one row
    per email with partial aggregation (a hot address is one row per task), and
    rows merge by the smallest or largest (sequence, value) pair. The merge gives
    the same state in any order and when a batch comes twice. Parts are kept in tiers.
T3  dedup: the ledger anti-join inside T1 has an unbounded horizon; the
    opt-in ``dedup_within_watermark`` bounds state with a watermark instead.
T4  ``start_live_totals``: counts per (folder, domain) of each committed batch;
    a batch that comes twice rewrites its own counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..operators.routing import ledger_key
from ..operators.text import sanitize_domain, sanitize_folder, strip_ws
from ..plans import ingest
from .tiers import BUCKETS, FAN, Tiers

EPOCH_SPAN = 1_000_000_000
COMMIT_SCHEMA = "committed boolean, runs array<string>, batch_id long"
KEY_SCHEMA = "key string"


def write_mail_drop(batch: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Lay out a batch as the files a mail collector would drop, one folder per day.

    A day's mail is spread over up to ``files_per_day`` files by message key, so the
    redelivered copies of a message share a file and reach the stream in one
    micro-batch, where arrival order is the sequence order.
    """
    part = F.pmod(F.xxhash64(ledger_key("message_id", "imap_uid")), F.lit(files_per_day))
    batch.repartition("received_date", part).write.mode("overwrite").partitionBy("received_date").parquet(path)


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``; None if nothing was ever written there. What exists but cannot be read is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """(batch_id, runs) per committed batch; None before the first commit.

    A commit folder that exists but cannot be read is an error, never an empty state.
    """
    c = _found(spark, f"{state}/commits", COMMIT_SCHEMA)
    if c is None:
        return None
    c = c.select("batch_id", "runs") if before is None else c.filter(F.col("batch_id") < before).select("batch_id", "runs")
    return None if c.isEmpty() else c


def live_runs(spark: SparkSession, state: str, before: int | None = None) -> list[str]:
    """The runs that the last commit names: fewer than ``fan`` for each level.

    A batch reads the commit of the one before it; only the first batch of a stream looks through all commits.
    """
    c = _found(spark, f"{state}/commits", COMMIT_SCHEMA)
    if c is None:
        return []
    last = None if before is None else c.filter(F.col("batch_id") == before - 1).select("batch_id", "runs").first()
    if last is None:
        earlier = c if before is None else c.filter(F.col("batch_id") < before)
        last = earlier.agg(F.max("batch_id").alias("batch_id"), F.max_by(F.struct("runs"), "batch_id").alias("r")).select(
            "batch_id", "r.runs").first()
    if last["batch_id"] is not None and last["runs"] is None:
        raise ValueError(f"commit {last['batch_id']} names no runs: state of an earlier format")
    return list(last["runs"] or [])


def read_state(spark: SparkSession, state: str, name: str, before: int | None = None) -> DataFrame | None:
    """The committed rows of one output (``contacts``: the current contacts); None before the first commit."""
    done = committed(spark, state, before)
    if done is None:
        return None
    if name == "contacts":
        return contact_tiers(spark, state).read(live_runs(spark, state, before)).select(*upsert.CONTACT_COLUMNS)
    return spark.read.parquet(f"{state}/{name}").join(done.select("batch_id"), "batch_id", "left_semi").drop("batch_id")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each email, with the batch that wrote it."""
    fields = [c for c in upsert.CONTACT_COLUMNS if c != "email"]
    return rows.groupBy("email").agg(F.max_by(F.struct(*fields), "batch_id").alias("c"), F.max("batch_id").alias("batch_id")).select(
        *[F.col("email") if c == "email" else F.col(f"c.{c}").alias(c) for c in upsert.CONTACT_COLUMNS], "batch_id")


def contact_tiers(spark: SparkSession, state: str, fan: int = FAN, buckets: int = BUCKETS) -> Tiers:
    fields = upsert.empty_contacts(spark).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return Tiers(spark, f"{state}/contacts", f"{schema}, batch_id bigint", "email", lambda rows: _newest(rows), fan, buckets)


def key_tiers(spark: SparkSession, state: str, fan: int = FAN, buckets: int = BUCKETS) -> Tiers:
    """Ledger keys: ``m`` and a Message-ID, or ``u`` and a uid."""
    return Tiers(spark, f"{state}/keys", KEY_SCHEMA, "key", lambda rows: rows.distinct(), fan, buckets)


def _keys(message_id: Column, imap_uid: Column) -> Column:
    return F.filter(F.array(F.concat(F.lit("m"), message_id), F.concat(F.lit("u"), imap_uid)), lambda k: k.isNotNull())


def known_keys(batch: DataFrame, keys: Tiers, runs: list[str]) -> DataFrame:
    """The ledger rows that can meet ``batch`` (F2), whatever the size of the ledger."""
    mid = F.nullif(strip_ws("message_id"), F.lit(""))
    asked = batch.select(F.explode(_keys(mid, F.col("imap_uid"))).alias("key")).distinct()
    kind, value = F.substring("key", 1, 1), F.expr("substring(key, 2)")
    return keys.lookup(asked, runs).select(
        F.when(kind == "m", value).alias("message_id"), F.when(kind == "u", value).alias("imap_uid"))


def process_batch(batch: DataFrame, stream_batch: int, state: str, cfg: ingest.RunConfig, epoch: int = 1,
                  fan: int = FAN, buckets: int = BUCKETS) -> None:
    """T1 body: one micro-batch through the batch plan, outputs under its state batch id.

    The state id is ``epoch * 1e9 + stream batch id``: the same micro-batch
    replayed from the same checkpoint maps to the same folders, while a new
    stream over the same state (a new checkpoint) uses a new epoch.
    """
    spark = batch.sparkSession
    batch_id = epoch * EPOCH_SPAN + int(stream_batch)
    runs = live_runs(spark, state, before=batch_id)
    keys, contacts = key_tiers(spark, state, fan, buckets), contact_tiers(spark, state, fan, buckets)
    prior = contacts.read(runs).select(*upsert.CONTACT_COLUMNS)  # the run's semi-join reaches every run below the merge

    def write(name: str, df: DataFrame) -> DataFrame:
        path = f"{state}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    known = known_keys(batch, keys, runs).checkpoint()  # no more rows than the batch has keys; two joins read it
    r = ingest.run(batch, known, prior, cfg, cut=lambda df: write("scored", df), changed_only=True)
    write("outcomes", r.outcomes)
    ledger = write("ledger", r.ledger)
    write("events", r.events)
    write("new_leads", r.new_leads)
    keys.put(ledger.select(F.explode(_keys(F.col("message_id"), F.col("imap_uid"))).alias("key")).distinct(), batch_id, runs)
    live = contacts.put(r.contacts.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id, runs)
    spark.createDataFrame([(True, live)], "committed boolean, runs array<string>").coalesce(1).write.mode(
        "overwrite").parquet(f"{state}/commits/batch_id={batch_id}")


def start_ingest(spark: SparkSession, drop: str, state: str, checkpoint: str, schema,
                 cfg: ingest.RunConfig, files_per_trigger: int = 5, available_now: bool = True,
                 interval: str = "5 minutes", epoch: int = 1, fan: int = FAN, buckets: int = BUCKETS):
    """Start the ingest stream (``availableNow`` drains what is there; else a timed trigger).

    ``epoch`` must be the same whenever this checkpoint is restarted and differ
    between checkpoints that share ``state``.
    """
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(drop)
    w = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, bid: process_batch(df, bid, state, cfg, epoch, fan, buckets))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


# ---------------------------------------------------------------------------
# Streams over committed batches: contact state (T2) and live totals (T4)
# ---------------------------------------------------------------------------

def _follow_commits(spark: SparkSession, state: str, checkpoint: str, on_batch, commits_per_trigger: int):
    """Call ``on_batch(outcomes, newest id)`` with the outcomes (and ``batch_id``) of newly committed batches.

    At most ``commits_per_trigger`` ids are read to the driver per trigger; only their folders are listed.
    """
    def step(commits: DataFrame, _) -> None:
        ids = sorted({r["batch_id"] for r in commits.select("batch_id").collect()})
        if ids:
            own = commits.sparkSession
            on_batch(own.read.option("basePath", f"{state}/outcomes").parquet(
                *[f"{state}/outcomes/batch_id={i}" for i in ids]), ids[-1])

    src = spark.readStream.schema(COMMIT_SCHEMA).option("maxFilesPerTrigger", commits_per_trigger).parquet(
        f"{state}/commits")
    return (src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
            .trigger(availableNow=True).start())


def _write_by_batch(df: DataFrame, path: str) -> None:
    """Write rows under their source batch id; a batch that comes twice replaces its own rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


FIRST = ["first_name", "last_name", "phone", "org"]
LAST = ["subject", "received_at", "excerpt"]


def contact_parts(processed: DataFrame, by: tuple[str, ...] = ("email",)) -> DataFrame:
    """Per email the first non-empty fill fields and the last subject, time and excerpt,
    each as a (sequence, value) pair; the smallest or largest pair wins."""
    seq, text_fields = F.col("seq"), {"subject", *FIRST}

    def pair(c):
        given = F.col(c).isNotNull() if c not in text_fields else F.col(c).isNotNull() & (F.col(c) != "")
        return F.struct(seq, F.col(c).alias("value")) if c == "excerpt" else F.when(given, F.struct(seq, F.col(c).alias("value")))

    return processed.groupBy(*by).agg(
        F.min("seq").alias("first_seq"), *[F.min(pair(c)).alias(c) for c in FIRST], *[F.max(pair(c)).alias(c) for c in LAST])


def merge_parts(parts: DataFrame) -> DataFrame:
    """Merge contact parts into one row per email; merging merged rows again changes nothing."""
    return parts.groupBy("email").agg(
        F.min("first_seq").alias("first_seq"), *[F.min(c).alias(c) for c in FIRST], *[F.max(c).alias(c) for c in LAST])


PART_SCHEMA = ("email string, first_seq bigint, " + ", ".join(f"{c} struct<seq:bigint,value:string>" for c in FIRST)
               + ", subject struct<seq:bigint,value:string>, received_at struct<seq:bigint,value:timestamp>, "
               "excerpt struct<seq:bigint,value:string>")
HEAD_SCHEMA = "runs array<string>, version bigint"


def part_tiers(spark: SparkSession, out: str, fan: int = FAN, buckets: int = BUCKETS) -> Tiers:
    return Tiers(spark, f"{out}/parts", PART_SCHEMA, "email", merge_parts, fan, buckets)


def _part_runs(spark: SparkSession, out: str, before: int | None = None) -> list[str]:
    heads = _found(spark, f"{out}/heads", HEAD_SCHEMA)
    if heads is None:
        return []
    heads = heads if before is None else heads.filter(F.col("version") < before)
    return list(heads.agg(F.max_by("runs", "version").alias("runs")).first()["runs"] or [])


def start_contact_state(spark: SparkSession, state: str, out: str, checkpoint: str, commits_per_trigger: int = 100,
                        fan: int = FAN, buckets: int = BUCKETS):
    """Keep contact parts of every committed batch in tiers under ``out``; a new checkpoint needs a new ``out``."""
    def on_batch(outcomes: DataFrame, newest: int) -> None:
        own = outcomes.sparkSession
        parts = contact_parts(outcomes.filter(F.col("outcome") == "processed"))
        live = part_tiers(own, out, fan, buckets).put(parts, newest, _part_runs(own, out, before=newest))
        own.createDataFrame([(live,)], "runs array<string>").coalesce(1).write.mode("overwrite").parquet(
            f"{out}/heads/version={newest}")
    return _follow_commits(spark, state, checkpoint, on_batch, commits_per_trigger)


def read_contact_state(spark: SparkSession, out: str) -> DataFrame:
    """The contact state: one row per email."""
    m = part_tiers(spark, out).read(_part_runs(spark, out))
    return m.select(
        "email", "first_seq", *[F.col(f"{c}.value").alias(c) for c in FIRST],
        F.col("subject.value").alias("last_message_subject"), F.col("received_at.value").alias("last_message_received_at"),
        F.col("excerpt.value").alias("last_message_excerpt"))


def start_live_totals(spark: SparkSession, state: str, out: str, checkpoint: str, commits_per_trigger: int = 100):
    """T4: keep processed and created-lead counts per (folder, domain) for every committed batch."""
    def on_batch(outcomes: DataFrame, _: int) -> None:
        _write_by_batch(live_totals(outcomes, ("batch_id",)), out)
    return _follow_commits(spark, state, checkpoint, on_batch, commits_per_trigger)


def live_totals(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Processed and created-lead counts per (folder, domain)."""
    o = F.col("outcome")
    return outcomes.groupBy(*by, sanitize_folder("folder").alias("folder"),
                            sanitize_domain("from_domain").alias("domain")).agg(
        F.count_if(o.isin("processed", "missing_email")).alias("processed"),
        F.count_if(F.col("created")).alias("leads"))


def read_live_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals over all committed batches seen so far."""
    return spark.read.parquet(out).groupBy("folder", "domain").agg(
        F.sum("processed").alias("processed"), F.sum("leads").alias("leads"))


# ---------------------------------------------------------------------------
# T3 option
# ---------------------------------------------------------------------------

def dedup_within_watermark(stream: DataFrame, event_time: str, horizon: str = "7 days") -> DataFrame:
    """T3 (bounded): drop repeated ids seen within ``horizon`` of event time."""
    return (stream.withColumn("_key", ledger_key("message_id", "imap_uid")).withWatermark(event_time, horizon)
            .dropDuplicatesWithinWatermark(["_key"]).drop("_key"))
