"""Parquet inputs and the ``messages`` batch derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lpad3(c: Column) -> Column:
    return F.lpad(c, 3, "0")


def messages(spark: SparkSession, sf_dir: str, with_copies: bool = True) -> DataFrame:
    """Mail batch planted over ``documents`` (+ ``labels``).

    Schema: seq, message_id, imap_uid, folder, from_header, subject, body,
    received_date, date_header, label. ``seq`` is twice the document's id, plus one
    for a redelivered copy: unique at any size, a copy arriving right behind its
    original. The subject is the whole first line, the body holds the whole text.
    The label lookup is aggregated per ``doc_id``, so it can never fan rows out
    and Catalyst drops the join entirely when no label is selected.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = (
        read_table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
    )
    base = docs.join(labels, "doc_id", "left")
    seq = F.col("doc_id")
    u = (seq % 31).cast("string")
    sid = seq.cast("string")
    dom = F.concat(F.lit("d"), (seq % 11).cast("string"), F.lit(".example"))
    line1 = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    nl = F.lit("\n")
    body_tail = (
        F.when(
            seq % 5 == 0,
            F.concat(nl, F.lit("Tel. ufficio: +39 02 1234"), _lpad3(u), nl,
                     F.lit("Cell: +39 345 987 6"), _lpad3(u), nl,
                     F.lit("Azienda: Rossi Impianti S.r.l.")),
        )
        .when(
            seq % 5 == 1,
            F.concat(nl, F.lit("Phone: +33 1 44 55 66 77"), nl, F.lit("Fax: +33 1 44 55 66 78"),
                     nl, F.lit("Company - Nouvelle Energie S.A.S.")),
        )
        .when(seq % 5 == 2, F.concat(nl, F.lit("Buongiorno, vorremmo una quotazione e un offerta dettagliata?")))
        .otherwise(F.lit(""))
    )
    # self-introduction lines (company phrases, a noise team, a second address)
    intro = (
        F.when(seq % 13 == 3, F.concat(nl, F.lit("Sono Giulia Verdi"), u, F.lit(" della Verdi Costruzioni S.p.A.")))
        .when(seq % 13 == 5, F.concat(nl, F.lit("Mi chiamo Luca Neri e lavoro presso Neri Logistica, scrivete a luca.neri"),
                                      u, F.lit("@neri-logistica.example")))
        .when(seq % 13 == 7, F.concat(nl, F.lit("Lavoro per il team marketing")))
        .when(seq % 13 == 9, F.concat(nl, F.lit("La nostra azienda si chiama Bianchi & Figli")))
        .when(seq % 13 == 11, F.concat(nl, F.lit("sono marco di ufficio")))
        .otherwise(F.lit(""))
    )
    received_date = F.date_add(F.lit("2024-01-01").cast("date"), (seq % 30).cast("int"))
    m = base.select(
        (seq * 2).alias("seq"),
        F.when(seq % 41 == 0, F.lit("")).otherwise(F.concat(F.lit("<m"), sid, F.lit("@"), dom, F.lit(">"))).alias("message_id"),
        sid.alias("imap_uid"),
        F.when(seq % 3 == 0, F.lit("Sales")).otherwise(F.lit("INBOX")).alias("folder"),
        F.when(seq % 53 == 0, F.lit("not-an-email"))
        .when(seq % 59 == 0, F.lit("Undisclosed <>"))
        .when(seq % 61 == 0, F.concat(F.lit("mario"), u, F.lit("@"), dom, F.lit(" (Mario Rossi)")))
        .when(seq % 67 == 0, F.concat(F.lit("prima"), u, F.lit("@"), dom, F.lit(", Carla <carla@altra.example>")))
        .when(seq % 71 == 0, F.concat(F.lit('"Rossi, Mario <vendite>" <quoted'), u, F.lit("@"), dom, F.lit(">")))
        .otherwise(F.concat(F.lit("Dr. Mario Rossi"), u, F.lit(" <User"), u, F.lit("@"), F.upper(dom), F.lit(">")))
        .alias("from_header"),
        F.when(seq % 7 == 0, F.lit("Richiesta preventivo"))
        .when(seq % 7 == 1, F.lit("Quote request for services"))
        .when(seq % 7 == 2, F.lit("Richiesta informazioni"))
        .otherwise(line1)
        .alias("subject"),
        F.concat(F.col("text"), intro, body_tail).alias("body"),
        received_date.alias("received_date"),
        # RFC-2822 Date header; every 47th mail carries an unparsable one
        F.when(seq % 47 == 0, F.lit("not a date"))
        .when(seq % 43 == 2, F.concat(F.date_format(received_date, "EEE, d MMM yyyy"), F.lit(" 07:08:09 GMT")))
        .when(seq % 43 == 3, F.concat(F.date_format(received_date, "d MMM yy"), F.lit(" 07:08 EST")))
        .when(seq % 43 == 4, F.date_format(received_date, "EEE, dd MMM yyyy 23:59:59"))
        .otherwise(
            F.concat(
                F.date_format(received_date, "EEE, d MMM yyyy"), F.lit(" "),
                F.lpad((seq % 24).cast("string"), 2, "0"), F.lit(":"),
                F.lpad((seq % 60).cast("string"), 2, "0"), F.lit(":00 "),
                F.when(seq % 3 == 0, F.lit("+0000")).when(seq % 3 == 1, F.lit("+0100")).otherwise(F.lit("-0500")),
                F.when(seq % 43 == 1, F.lit(" (UTC)")).otherwise(F.lit("")),
            )
        )
        .alias("date_header"),
        F.col("label").cast("int").alias("label"),
    )
    if not with_copies:
        return m
    copies = m.filter(F.col("seq") % 20 == 0).withColumn("seq", F.col("seq") + 1)
    return m.unionByName(copies)


def labelled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records (id, label, subject, body, text): each labelled message once."""
    from ..operators.text import combine_text

    m = messages(spark, sf_dir, with_copies=False).filter(F.col("label").isNotNull())
    return m.select(F.col("seq").alias("id"), "label", "subject", "body",
                    combine_text("subject", "body").alias("text"))


def headers_map(df: DataFrame) -> Column:
    """Header map as the mail loader returns it: absent or empty headers are null.

    ``To`` and ``Reply-To`` come from the columns ``to_header`` and ``reply_to`` where the batch has them.
    """
    to = F.col("to_header") if "to_header" in df.columns else F.lit(None).cast("string")
    reply = [F.lit("Reply-To"), F.col("reply_to")] if "reply_to" in df.columns else []
    return F.create_map(
        F.lit("Message-ID"), F.nullif(F.col("message_id"), F.lit("")),
        F.lit("From"), F.col("from_header"),
        F.lit("To"), to,
        *reply,
        F.lit("Subject"), F.col("subject"),
        F.lit("Date"), F.col("date_header"),
    )
