"""New-lead notice text (P13): the message body a notifier would send, as a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# FIXED VALUES — notice wording
NEW_LEAD_SUBJECT = "Nuovo lead ricevuto"
NEW_LEAD_TITLE = "Nuovo lead inserito automaticamente:"
LABEL_NAME, LABEL_EMAIL, LABEL_COMPANY = "Nome: ", "Email: ", "Azienda: "
LABEL_PHONE, LABEL_RECEIVED = "Telefono: ", "Ricevuto alle: "


def _s(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def new_lead_notice(subject, first_name, last_name, email, company, phone, received_iso, notes) -> Column:
    """struct(subject, body): subject falls back to a fixed text; body lines joined by newlines."""
    nonempty_subject = F.when(_c(subject).isNotNull() & (_c(subject) != ""), _c(subject))
    body = F.concat_ws(
        "\n",
        F.lit(NEW_LEAD_TITLE),
        F.concat(F.lit(LABEL_NAME), _s(first_name), F.lit(" "), _s(last_name)),
        F.concat(F.lit(LABEL_EMAIL), _s(email)),
        F.concat(F.lit(LABEL_COMPANY), _s(company)),
        F.concat(F.lit(LABEL_PHONE), _s(phone)),
        F.concat(F.lit(LABEL_RECEIVED), _s(received_iso)),
        F.lit(""),
        _s(notes),
    )
    return F.struct(F.coalesce(nonempty_subject, F.lit(NEW_LEAD_SUBJECT)).alias("subject"), body.alias("body"))


# FIXED VALUES — sheet-update notice wording
SHEET_SUBJECT = "AVVISO: è stato aggiunto un cliente al foglio excel!"
LABEL_CLIENT_EMAIL, LABEL_FILE, LABEL_ROW = "Email cliente: ", "File Excel: ", "Riga inserita: "
LABEL_UPDATED, LABEL_NOTE = "Aggiornato alle: ", "Estratto nota:"


def sheet_update_notice(first_name, last_name, email, company, phone, notes, sheet_path: str,
                        row_number, updated_at) -> Column:
    """struct(subject, body) of the notice sent after a lead row is appended to the sheet.

    ``row_number`` (the sheet row, header = 1) adds its line only when positive;
    ``updated_at`` is the ISO text of the update time (seconds).
    """
    row = _c(row_number)
    row_line = F.when(row.isNotNull() & (row > 0), F.concat(F.lit(LABEL_ROW), row.cast("string")))
    body = F.concat_ws(
        "\n",
        F.lit(SHEET_SUBJECT), F.lit(""),
        F.concat(F.lit(LABEL_CLIENT_EMAIL), _s(email)),
        F.concat(F.lit(LABEL_NAME), _s(first_name), F.lit(" "), _s(last_name)),
        F.concat(F.lit(LABEL_COMPANY), _s(company)),
        F.concat(F.lit(LABEL_PHONE), _s(phone)),
        F.lit(LABEL_FILE + sheet_path),
        row_line,
        F.concat(F.lit(LABEL_UPDATED), _s(updated_at)),
        F.lit(""), F.lit(LABEL_NOTE), _s(notes),
    )
    return F.struct(F.lit(SHEET_SUBJECT).alias("subject"), body.alias("body"))
