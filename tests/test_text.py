from pyspark.sql import functions as F

from conftest import one
from leadforge.operators import text


def test_plain_text_and_excerpt(spark):
    html = "<html><style>p{}</style><script>x()</script><p>Ciao&nbsp;&amp; <b>mondo</b></p><!-- c --></html>"
    assert one(spark, text.plain_text(F.col("h")), h=html) == "Ciao & mondo"
    assert one(spark, text.plain_text(F.col("h")), h="a < b and c") == "a < b and c"
    long = "x" * 500
    out = one(spark, text.excerpt(F.col("h")), h=long)
    assert len(out) == 400 and out.endswith("…")


def test_sender_domain(spark):
    assert one(spark, text.sender_domain(F.col("f")), f="Mario <Mario@Shop.Example>") == "shop.example"
    assert one(spark, text.sender_domain(F.col("f")), f="senza-chiocciola") is None


def test_received_at(spark):
    got = one(spark, F.date_format(text.received_at(F.col("d")), "yyyy-MM-dd HH:mm:ss"), d="Wed, 8 Oct 2025 10:33:21 +0100")
    assert got == "2025-10-08 09:33:21"
    assert one(spark, text.received_at(F.col("d")), d="ieri sera") is None


def test_combine_and_bands(spark):
    assert one(spark, text.combine_text(F.col("s"), F.col("b")), s="  Oggetto ", b="\nCorpo  ") == "Oggetto\nCorpo"
    assert one(spark, text.combine_text(F.col("s"), F.col("b")), s="", b="Corpo") == "Corpo"
    assert [one(spark, text.confidence_band(F.lit(v)), x="1") for v in (0.95, 0.7, 0.5, 0.1)] == \
        ["high", "medium", "low", "very_low"]


def test_notices(spark):
    from leadforge.operators import notify
    n = one(spark, notify.new_lead_notice(F.lit(None), F.col("f"), F.lit(None), F.col("e"), F.lit(None),
                                          F.lit(None), F.lit(None), F.col("x")), f="Anna", e="a@b.example", x="nota")
    assert n["subject"] == "Nuovo lead ricevuto"
    assert n["body"].split("\n") == ["Nuovo lead inserito automaticamente:", "Nome: Anna ", "Email: a@b.example",
                                     "Azienda: ", "Telefono: ", "Ricevuto alle: ", "", "nota"]
    s = one(spark, notify.sheet_update_notice(F.col("f"), F.col("l"), F.col("e"), F.lit(None), F.lit(None),
                                              F.col("x"), "/data/leads.xlsx", F.lit(0), F.col("t")),
            f="Anna", l="Neri", e="a@b.example", x="nota", t="2024-03-01T10:00:00")
    lines = s["body"].split("\n")
    assert lines[0] == s["subject"] and "File Excel: /data/leads.xlsx" in lines
    assert not any(x.startswith("Riga inserita") for x in lines) and lines[-1] == "nota"


def test_dates_and_addresses_of_real_headers(spark):
    from leadforge.operators import text

    dates = {"Mon, 1 Jan 2024 09:30:00 +0100 (CET)": "2024-01-01 08:30:00", "1 Jan 24 09:30 GMT": "2024-01-01 09:30:00",
             "Tue, 02 Jan 2024 09:30:00 EST": "2024-01-02 14:30:00", "3 jan 1999 09:30:01 +0000 (UTC)": "1999-01-03 09:30:01",
             "Wed, 3 Jan 2024 09:30:00": "2024-01-03 09:30:00", "yesterday": None, "": None}
    rows = spark.createDataFrame([(d,) for d in dates], "d string")
    got = {r["d"]: r["t"] for r in rows.select("d", text.received_at("d").cast("string").alias("t")).collect()}
    assert got == dates
    senders = {"mario@x.it (Mario Rossi)": ("x.it", "Mario Rossi"), "a@b.it, Carla <c@d.it>": ("b.it", ""),
               '"A <x>" <m@x.it>': ("x.it", "A <x>"), "Anna Neri <anna@Neri.IT>": ("neri.it", "Anna Neri"),
               "Undisclosed <>": (None, "Undisclosed"), "plain@y.it": ("y.it", "")}
    rows = spark.createDataFrame([(h,) for h in senders], "h string")
    found = rows.select("h", text.sender_domain("h").alias("d"), text.display_name_of("h").alias("n")).collect()
    assert {r["h"]: (r["d"], r["n"]) for r in found} == senders


def test_character_references(spark):
    from leadforge.operators import text

    cases = {"<b>Caff&egrave;</b> &#233; &#x20AC;": "Caffè é €", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "a &amp;lt; b": "a &lt; b",
             "<p>a &amp;lt; b</p>": "a < b", "plain": "plain"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["p"] for r in rows.select("t", text.plain_text("t").alias("p")).collect()} == cases


def test_odd_addresses_follow_the_policy(spark):
    cases = {
        "Team: a@b.it, c@d.it;": ("a@b.it", ""), '"a b"@x.it': ('"a b"@x.it', ""), "M <m@x.it": ("m@x.it", "M"),
        "Rossi\\, M <m@x.it>": ("m@x.it", "Rossi M"), 'M (a "b) c <m@x.it>': ("m@x.it", "M c"),
        '"unclosed <m@x.it>': ("m@x.it", "unclosed"), "<@x.it>": ("", ""), "a b@x.it": ("", ""), "a@b@c.it": ("", ""),
        "Team:;": ("", ""), "not-an-email": ("not-an-email", ""), '"Neri, M" <m@x.it>, b@y.it': ("m@x.it", "Neri, M"),
        "m@x.it (Sig. (Q) Neri)": ("m@x.it", "Sig. (Q) Neri"), '"Q \\"x\\" Y" <q@x.it>': ("q@x.it", 'Q "x" Y'), "": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r["h"]: (r["a"], r["n"]) for r in rows.select(
        "h", text.address_of("h").alias("a"), text.normalize_whitespace(text.display_name_of("h")).alias("n")).collect()}
    assert got == cases


def test_odd_dates(spark):
    cases = {"Mon Jan  1 09:30:00 2024": "2024-01-01 09:30:00", "Mon, 1 Jan 2024 09.30.00 +0100": "2024-01-01 08:30:00",
             "1 January 2024 09:30 CEST": "2024-01-01 09:30:00", "1 Sept 2024 09:30:00 +0000": None, "Jan 1, 2024": None}
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(d,) for d in cases], "d string")
    got = {r["d"]: r["t"] for r in rows.select("d", F.date_format(text.received_at("d"), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == cases
