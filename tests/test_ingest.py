"""Ingestion run semantics on hand-made messages (create, merge, duplicates, idempotence)."""

import datetime as dt

from pyspark.sql import functions as F

from leadforge.operators import upsert
from leadforge.plans import ingest

SCHEMA = ("seq long, message_id string, imap_uid string, folder string, from_header string, subject string, "
          "body string, received_date date, date_header string, label int")
D = dt.date(2024, 3, 1)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, rows, ledger=None, contacts=None, **cfg):
    """One run; its outputs are checkpointed, as a scheduled run would persist them."""
    r = ingest.run(batch(spark, rows), ledger if ledger is not None else ingest.empty_ledger(spark),
                   contacts if contacts is not None else upsert.empty_contacts(spark), ingest.RunConfig(**cfg),
                   cut=lambda df: df.checkpoint())
    return ingest.RunResult(r.outcomes, r.contacts.checkpoint(), r.ledger.checkpoint(), r.events, r.new_leads)


LEAD = "Richiesta preventivo"
ROWS = [
    (1, "<a1@x>", "101", "INBOX", "Giulia Neri <giulia@neri.example>", LEAD, "Buongiorno, un preventivo?", D,
     "Fri, 1 Mar 2024 09:00:00 +0100", None),
    (2, "<a2@x>", "102", "INBOX", "Giulia Neri <giulia@neri.example>", LEAD,
     "Ecco i recapiti\nCell: 347 5550100\nAzienda: Neri Serramenti srl", D, "Fri, 1 Mar 2024 10:00:00 +0100", None),
    (3, "<a1@x>", "103", "INBOX", "Giulia Neri <giulia@neri.example>", LEAD, "copia", D, None, None),
    (4, "<a4@x>", "102", "INBOX", "Giulia Neri <giulia@neri.example>", LEAD, "stesso uid", D, None, None),
    (5, "<a5@x>", "105", "Sales", "senza-indirizzo", LEAD, "x", D, None, None),
    (6, "<a6@x>", "106", "Sales", "Paolo <paolo@rossi.example>", "Aggiornamento", "nulla da segnalare", D, None, None),
    (7, "", "107", "Sales", "Anna <anna@bianchi.example>", LEAD, "preventivo", D, None, None),
]


def test_outcomes_and_merge(spark):
    r = run(spark, ROWS)
    out = {row["seq"]: row for row in r.outcomes.collect()}
    assert [out[i]["outcome"] for i in range(1, 8)] == [
        "processed", "processed", "duplicate", "duplicate", "not_allowed", "not_lead", "processed"]
    assert out[1]["created"] and not out[2]["created"] and out[7]["created"]
    assert out[5]["reason"] == "Invalid sender address: 'senza-indirizzo'"
    c = {row["email"]: row for row in r.contacts.collect()}
    g = c["giulia@neri.example"]
    assert (g["first_name"], g["last_name"], g["phone"], g["org"]) == ("Giulia", "Neri", "+393475550100", "Neri Serramenti srl")
    assert g["last_message_received_at"] == dt.datetime(2024, 3, 1, 9, 0)
    ledger = {(row["message_id"], row["imap_uid"]) for row in r.ledger.collect()}
    assert ("uid:107", "107") in ledger and ("<a1@x>", "101") in ledger and len(ledger) == 5


def test_allow_list(spark):
    r = run(spark, ROWS, allowed_domains=["Rossi.example"])
    out = {row["seq"]: row for row in r.outcomes.collect()}
    assert out[1]["outcome"] == "not_allowed" and out[1]["reason"] == "Sender domain not allowed: neri.example"
    assert out[6]["outcome"] == "not_lead"


def test_rerun_is_idempotent(spark):
    first = run(spark, ROWS)
    again = run(spark, ROWS, ledger=first.ledger.select("message_id", "imap_uid"), contacts=first.contacts)
    counts = {row["outcome"]: row["n"] for row in again.outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert counts == {"duplicate": 7}
    assert again.ledger.count() == 0 and again.new_leads.count() == 0
    assert again.contacts.count() == first.contacts.count()


def test_second_run_updates_contact(spark):
    first = run(spark, ROWS[:1])
    later = [(8, "<a8@x>", "108", "INBOX", "Giulia Neri <giulia@neri.example>", "Nuova richiesta di preventivo",
              "Tel 02 5550999", D, "Sat, 2 Mar 2024 08:00:00 +0000", None)]
    second = run(spark, later, ledger=first.ledger.select("message_id", "imap_uid"), contacts=first.contacts,
                 run_ts="2024-03-02 00:00:00")
    g = second.contacts.filter(F.col("email") == "giulia@neri.example").first()
    assert g["phone"] == "025550999" and g["last_message_subject"] == "Nuova richiesta di preventivo"
    assert g["created_at"] == dt.datetime(2024, 2, 1)  # kept from the first run
    assert second.outcomes.first()["created"] is False


def test_ambiguous_keys_stop_the_run(spark):
    import pytest

    rows = [ROWS[0], (9, "<other@x>", "101", "INBOX", "Giulia Neri <giulia@neri.example>", LEAD, "altro", D, None, None)]
    with pytest.raises(ValueError):
        ingest.run(batch(spark, rows), ingest.empty_ledger(spark), upsert.empty_contacts(spark),
                   ingest.RunConfig(check_keys=True))
    assert not ingest.ambiguous_keys(batch(spark, ROWS[:2]))


def test_dedup_with_conflicting_keys_follows_message_order(spark):
    import random

    from leadforge.operators import routing

    random.seed(3)
    rows = [(0, "A", "1"), (1, "B", "1"), (2, "B", "2"), (3, "", "2"), (4, None, None), (5, None, None)]
    rows += [(10 + i, random.choice(["", "X", "Y", "Z", "W"]), random.choice([None, "7", "8", "9"])) for i in range(60)]
    mids, uids, want = set(), set(), set()
    for seq, mid, uid in rows:
        if (mid and mid in mids) or (uid and uid in uids):
            want.add(seq)
            continue
        mids.add(mid or object())
        uids.add(uid or object())
    df = spark.createDataFrame(rows, "seq bigint, message_id string, imap_uid string")
    got = {r["seq"] for r in routing.duplicate_flags(df).filter("duplicate").collect()}
    assert got == want and {2, 4, 5}.isdisjoint(got)


RAW = [
    ("10", b"Message-ID: <r1@x>\nFrom: Giulia Neri <giulia@neri.example>\nTo: vendite@ours.example\n"
           b"Reply-To: Sara Blu <sara@blu.example>\nSubject: Richiesta preventivo\nDate: Fri, 1 Mar 2024 09:00:00 +0100\n\nCell: 347 5550100"),
    ("11", b""), ("12", None), ("13", b"\njust words, no header"),
    ("14", b"Message-ID: <r5@x>\nFrom: Anna <anna@bianchi.example>\nSubject: Richiesta preventivo\n\npreventivo"),
    ("15", b"Message-ID: <r5@x>\nFrom: Anna <anna@bianchi.example>\nSubject: Richiesta preventivo\n\npreventivo"),
]


def mail_batch(spark, rows):
    from leadforge.sources import mail
    parsed = mail.parse_raw(spark.createDataFrame(rows, "path string, content binary"), "path", "content", faults=True)
    return mail.to_batch(parsed, F.col("path"), "drop")


def run_mail(spark, rows, ledger=None):
    return ingest.run(mail_batch(spark, rows), ledger if ledger is not None else ingest.empty_ledger(spark),
                      upsert.empty_contacts(spark), ingest.RunConfig(), cut=lambda df: df.checkpoint())


def test_raw_mail_to_contacts_with_faults(spark):
    from leadforge.operators import metrics
    r = run_mail(spark, RAW)
    out = {row["seq"]: row for row in r.outcomes.collect()}
    assert [out[i]["outcome"] for i in range(10, 16)] == ["processed", "error", "error", "error", "processed", "duplicate"]
    assert [out[i]["reason"] for i in (11, 12, 13)] == ["mail has no content"] * 2 + ["mail has no headers"]
    assert {row["email"] for row in r.contacts.collect()} == {"sara@blu.example", "anna@bianchi.example"}
    event = {row["seq"]: row["payload"] for row in r.events.collect()}[10]
    assert event["headers"]["To"] == "vendite@ours.example" and event["headers"]["Reply-To"] == "Sara Blu <sara@blu.example>"
    assert sorted(row["message_id"] for row in r.ledger.collect()) == ["<r1@x>", "<r5@x>"]
    errors = metrics.counter_rows(r.outcomes).filter("metric = 'errors'").collect()
    assert [(e["folder"], e["domain"], e["value"]) for e in errors] == [("drop", "unknown", 3)]
    stats = metrics.run_stats(r.outcomes).first()
    assert (stats["total"], stats["processed"], stats["skipped"]) == (6, 2, 1)


def test_a_failed_mail_is_taken_when_it_comes_again(spark):
    first = run_mail(spark, RAW[1:2])
    again = run_mail(spark, [("11", RAW[4][1])], ledger=first.ledger.select("message_id", "imap_uid"))
    assert [row["outcome"] for row in again.outcomes.collect()] == ["processed"]


def test_one_mail_that_breaks_the_parser_does_not_stop_the_run(spark, tmp_path):
    from leadforge.sources import mail
    for i, (_, content) in enumerate(RAW):
        (tmp_path / f"m{i}.eml").write_bytes(content or b" ")
    batch = mail.load_batch(spark, str(tmp_path), folder="drop").collect()
    assert sorted(b["seq"] for b in batch) == [1, 2, 3, 4, 5, 6] and sum(b["fault"] is not None for b in batch) == 3
    assert mail._parse_one(b"From: a@b\n\nx", True, lambda *a, **k: 1 / 0, None)[-1] == "mail cannot be read: ZeroDivisionError"


def test_the_wide_batch_is_read_once_and_only_kept_mail_is_excerpted(spark):
    from conftest import SF_SMALL
    from leadforge.operators import upsert
    from leadforge.plans import ingest
    from leadforge.sources.tables import messages
    batch = messages(spark, SF_SMALL).checkpoint()
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.checkpoint()
    out = ingest.run(batch, ingest.empty_ledger(spark), upsert.empty_contacts(spark),
                     ingest.RunConfig(allowed_domains=["d1.example"]), cut=cut).outcomes
    assert "Union" not in plans[0]
    row = out.groupBy("outcome").agg({"excerpt": "count", "lead_score": "count", "seq": "count"}).collect()
    got = {r["outcome"]: (r["count(excerpt)"], r["count(lead_score)"], r["count(seq)"]) for r in row}
    assert got["processed"][0] == got["processed"][1] == got["processed"][2] > 0
    assert got["not_lead"][0] == 0 and got["not_lead"][1] == got["not_lead"][2] > 0
    assert got["not_allowed"][:2] == (0, 0) and got["not_allowed"][2] > 0


def test_page_behind_an_empty_page_is_empty(spark):
    from leadforge.sources.sinks import contacts_page_after
    contacts = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, id div 2) AS created_at, format_string('%02d', id) AS id FROM range(10)")

    def ids(limit, offset):
        return [r["id"] for r in contacts_page_after(contacts, limit, offset).orderBy("created_at", "id").collect()]
    assert ids(3, 2) == ["05", "06", "07"]
    assert ids(3, 6) == ["09"]
    assert ids(3, 8) == []
    assert ids(3, 20) == []
