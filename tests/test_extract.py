from pyspark.sql import functions as F

from conftest import one
from leadforge.operators import extract


def test_reply_to_wins_over_from(spark):
    h = {"From": "Anna Bianchi <anna@alpha.example>", "Reply-To": "Luca Verdi <luca@beta.example>"}
    r = one(spark, extract.parse_contact(F.col("body"), F.col("h")), body="Buongiorno", h=h)
    assert (r["email"], r["first_name"], r["last_name"]) == ("luca@beta.example", "Luca", "Verdi")


def test_from_address_and_titles(spark):
    r = one(spark, extract.parse_contact(F.col("body"), F.col("h")), body="ciao",
            h={"From": "Dott. Carla De Santis <carla@gamma.example>"})
    assert (r["email"], r["first_name"], r["last_name"]) == ("carla@gamma.example", "Carla", "De Santis")


def test_body_email_when_headers_have_none(spark):
    r = one(spark, extract.parse_contact(F.col("body"), F.col("h")), body="scrivere a ufficio.acquisti@delta.example",
            h={"From": "Anonimo <>"})
    assert r["email"] == "ufficio.acquisti@delta.example"


def test_no_phone(spark):
    r = one(spark, extract.best_phone(F.col("body")), body="Nessun numero qui, grazie.")
    assert r is None


def test_cell_beats_landline(spark):
    body = "Tel. 02 5550123\nCellulare: 347 5550199\n"
    assert one(spark, extract.best_phone(F.col("b")), b=body) == "+393475550199"


def test_fax_line_is_skipped(spark):
    body = "Fax: 02 5550777\nTelefono ufficio 02 5550888"
    assert one(spark, extract.best_phone(F.col("b")), b=body) == "025550888"


def test_fax_only_number_still_found_by_fallback(spark):
    assert one(spark, extract.best_phone(F.col("b")), b="Fax 06 5550444") == "065550444"


def test_normalize_phone_rules(spark):
    cases = {"0039 06 5550101": "+39065550101", "39 340 5550102": "+393405550102",
             "340 5550103": "+393405550103", "12-34": None, "+44 20 5550 1004": "+442055501004"}
    for raw, want in cases.items():
        assert one(spark, extract.normalize_phone(F.col("p")), p=raw) == want, raw


def test_title_case_like_python(spark):
    r = one(spark, extract.split_name(F.col("n")), n="  prof.  o'brien  de-luca ")
    assert (r["first_name"], r["last_name"]) == ("O'Brien", "De-Luca")


def test_clean_company(spark):
    cases = {"acme": None, "acme 24": "acme 24", "Team Marketing": None, " - NORD Impianti S.p.A. ;": "NORD Impianti S.p.A",
             "ab": None}
    for raw, want in cases.items():
        assert one(spark, extract.clean_company(F.col("c")), c=raw) == want, raw


def test_company_phrase_and_name(spark):
    r = one(spark, extract.company_phrase(F.col("t")), t="Salve, sono Marco Neri della Neri Trasporti")
    assert r["company"] == "Neri Trasporti" and r["name"] == "Marco Neri"


def test_unclean_phrase_company_keeps_name(spark):
    r = one(spark, extract.company_phrase(F.col("t")), t="sono paolo di marketing")
    assert r["company"] is None and r["name"] == "paolo"


def test_org_line_rules(spark):
    cases = {"Company - Nouvelle Energie S.A.S.": "Nouvelle Energie S.A.S.", "Azienda: Rossi Impianti S.r.l.": "Rossi Impianti S.r.l.",
             "Grazie e buona giornata": None, "Verdi Costruzioni srl": "Verdi Costruzioni srl"}
    for line, want in cases.items():
        assert one(spark, extract.org_from_line(F.col("l")), l=line) == want, line


def test_exact_address_mode(spark):
    h = {"From": '"Rossi, Mario" <mario@rossi.example>'}
    r = one(spark, extract.parse_contact(F.col("b"), F.col("h"), exact_addresses=True), b="ciao", h=h)
    assert (r["email"], r["first_name"], r["last_name"]) == ("mario@rossi.example", "Rossi,", "Mario")
    plain = one(spark, extract.parse_contact(F.col("b"), F.col("h")), b="ciao", h=h)
    assert plain["email"] == "mario@rossi.example"


def test_evaluation_writer(spark, tmp_path):
    from leadforge.operators import evaluate as ev
    from leadforge.sources.sinks import write_evaluation
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "label int, score double")
    write_evaluation(str(tmp_path / "ev"), ev.evaluate(df), ev.roc_curve(df), ev.pr_curve(df))
    back = {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "ev" / "metrics")).collect()}
    assert back["roc_auc"] == 0.75 and back["tp"] == 1.0


def test_contact_parts_are_taken_once_a_message(spark):
    """each phrase is sought once in a text, and the five fields come from one struct."""
    from conftest import SF_SMALL
    from leadforge.plans.queries import QUERIES
    plan = QUERIES["parse_contact"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.count("Relation [")  # originals and copies
    assert branches == 2
    # phrase 5: its gate, once over the text, once over the match for its company
    assert plan.count("denominata)") == 3 * branches


def test_number_over_two_lines_and_first_company(spark):
    assert one(spark, extract.best_phone(F.col("b")), b="chiamare 02 555\n0123 grazie") == "025550123"
    assert one(spark, extract.best_phone(F.col("b")), b="ordine 12 34 56\nfine") is None
    body = "Salve\nVerdi Costruzioni srl\nAzienda: Rossi Impianti"
    assert one(spark, extract.org_from_lines(F.col("b")), b=body) == "Verdi Costruzioni srl"
    assert one(spark, extract.org_from_lines(F.col("b")), b="Salve\nGrazie") is None
