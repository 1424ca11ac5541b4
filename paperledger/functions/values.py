"""Validation and normalisation of single values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings

# Unicode blanks that java.util.regex does not count as \s; they are mapped to
# plain blanks before any pattern runs.
WIDE_BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = " \t\n\u000b\f\r"

# Check weights of the eleven business-number digits.
ABN_WEIGHTS = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
# Month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# City names and their time zones.
CITY_ZONES = {
    "sydney": "Australia/Sydney",
    "melbourne": "Australia/Sydney",
    "canberra": "Australia/Sydney",
    "hobart": "Australia/Hobart",
    "brisbane": "Australia/Brisbane",
    "adelaide": "Australia/Adelaide",
    "darwin": "Australia/Darwin",
    "perth": "Australia/Perth",
}
# Letter shapes that character recognition confuses.
FOLD_FROM, FOLD_TO = "L0158", "IOISB"


def sql_text(value: str) -> str:
    """A text value as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: dict[str, str]) -> Column:
    # One parsed expression instead of one driver call per literal.
    return F.expr(f"map({', '.join(sql_text(x) for kv in pairs.items() for x in kv)})")


def plain_blanks(text: Column) -> Column:
    """Map every Unicode blank to a plain one."""
    return F.translate(text, WIDE_BLANKS, " " * len(WIDE_BLANKS))


def strip(text: Column) -> Column:
    """Trim all white space, not just blanks."""
    return F.btrim(text, F.lit(BLANKS + WIDE_BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def unit_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit the length limits are given in."""
    return F.length(F.encode(text, "UTF-16BE")) / 2


def round2(number: Column) -> Column:
    """Round half up to cents with the small upward nudge the rules ask for."""
    nudged = F.floor((number + F.lit(2.0**-52)) * 100 + 0.5) / 100
    # floor() gives a 64-bit number; a double of that size has no cents left to round.
    return F.when(F.abs(number) < 9.2e16, nudged).otherwise(number)


def parse_amount(text: Column) -> Column:
    """Money text to a number, or null: ``$4,850.00``, ``AUD 4850``, ``Rs 321.68``."""
    # Marks before an amount, and its shape.
    bare = F.regexp_replace(text, r"\A\s*(?i:AUD|INR|Rs\.?|₹)|[$€\s]", "")
    digits = F.regexp_extract(bare, r"\A(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?\z", 0)
    number = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    # A one-element array binds the number once: inside other arrays a repeated expression is computed again.
    return F.get(F.transform(F.array(number), lambda n: F.when(n < float("inf"), round2(n))), F.lit(0))


def number_text(number: Column) -> Column:
    """Shortest decimal text of a number: 245 -> ``245``, 267.3 -> ``267.3``."""
    exact = number.try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.regexp_replace(exact, r"\.?0+$", ""), number.cast("string"))


def two_decimals(number: Column) -> Column:
    return F.format_string("%.2f", number)


def normalise_date(text: Column) -> Column:
    """Day-first or ISO date text to ``yyyy-MM-dd``; impossible dates give null."""
    # The three shapes of a date.
    iso = r"\A\d{4}-\d{1,2}-\d{1,2}\z"
    numeric = r"\A(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{2}|\d{4})\z"
    named = r"\A(\d{1,2})(?:-([A-Za-z]{3})-|\s+([A-Za-z]{3,9})\s+)(\d{2}|\d{4})\z"

    def order(s: Column) -> Column:
        return (
            F.when(s.rlike(iso), s)
            .when(s.rlike(numeric), F.regexp_replace(s, numeric, "$3-$2-$1"))
            .when(s.rlike(named), F.regexp_replace(s, named, "$4-$2$3-$1"))
        )

    months = literal_map({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)})

    def build(parts: Column) -> Column:
        year, month, day = parts[0], parts[1], parts[2]
        full_year = F.when(
            F.length(year) == 2, F.concat(F.when(year <= "49", "20").otherwise("19"), year)
        ).otherwise(year)
        number = F.when(month < "A", F.lpad(month, 2, "0")).otherwise(
            months[F.lower(F.substring(month, 1, 3))]
        )
        return F.concat(full_year, F.lit("-"), F.coalesce(number, F.lit("x")), F.lit("-"), F.lpad(day, 2, "0"))

    def check(built: Column) -> Column:
        real = built.try_cast("date").isNotNull() & (built >= "0100")
        return F.when(real, built)

    # One-element arrays bind the text and each intermediate value once instead of inlining it.
    ordered = F.filter(F.transform(F.array(strip(text)), order), lambda o: o.isNotNull())
    built = F.transform(F.transform(ordered, lambda o: F.split(o, "-")), build)
    return F.get(F.transform(built, check), F.lit(0))


def abn_ok(text: Column) -> Column:
    """Checksum of an eleven-digit business number."""
    digits = F.regexp_replace(text, r"\s+", "")
    total = F.lit(0)
    for i, weight in enumerate(ABN_WEIGHTS):
        digit = F.ascii(F.substring(digits, i + 1, 1)) - (49 if i == 0 else 48)
        total = total + digit * weight
    return digits.rlike(r"\A\d{11}\z") & (total % 89 == 0)


def compute_gst(amount: Column, basis: Column, registered: Column) -> Column:
    return F.when(
        registered,
        F.when(basis == "inclusive", round2(amount / 11)).when(basis == "exclusive", round2(amount * F.lit(0.1))),
    )


def clean_invoice(text: Column) -> Column:
    """Drop blank numbers and made-up ones (ten or more times the same digit)."""
    trimmed = blank_to_null(text)
    made_up = F.regexp_replace(trimmed, r"\D", "").rlike(r"\A(\d)\1{9,}\z")
    return F.when(~made_up, trimmed)


def gate(extraction: Column, settings: Settings = DEFAULTS) -> Column:
    """Grade one extraction struct: high, partial or low."""
    return gate_from(
        extraction["amount"]["value"],
        extraction["amount"]["confidence"],
        extraction["date"]["value"],
        extraction["date"]["confidence"],
        extraction["vendor"]["value"],
        F.lit(settings.amount_high),
        F.lit(settings.amount_low),
        F.lit(settings.date_high),
    )


def gate_from(
    amount: Column,
    amount_conf: Column,
    date: Column,
    date_conf: Column,
    vendor: Column,
    amount_high: Column,
    amount_low: Column,
    date_high: Column,
) -> Column:
    """The grading rule with its thresholds as columns, so a grid can be swept."""
    usable = amount.isNotNull() & (amount_conf >= amount_high)
    complete = date.isNotNull() & (date_conf >= date_high) & vendor.isNotNull()
    middling = amount.isNotNull() & (amount_conf >= amount_low)
    return (
        F.when(usable & complete, "high").when(usable | middling, "partial").otherwise("low")
    )


def fold_case(name: Column) -> Column:
    """Upper case with every run of other characters as one blank."""
    return F.trim(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", " "))


def fold_shapes(name: Column) -> Column:
    """Case fold plus the folding of look-alike characters."""
    return F.translate(fold_case(name), FOLD_FROM, FOLD_TO)


def format_aud(amount: Column) -> Column:
    money = F.format_string("%,.2f", F.abs(amount).cast("double"))
    return F.concat(F.when(amount < 0, "-$").otherwise("$"), money)


def city_zone(text: Column) -> Column:
    return literal_map(CITY_ZONES)[F.lower(strip(text))]


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def decode_list(text: Column) -> Column:
    """JSON list of text with an empty list for anything unreadable."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def archive_path(business_id: Column, uploaded_at: Column, media_id: Column, mime: Column) -> Column:
    """Where a bill image is kept: ``business/yyyy/MM/media.ext``."""
    # File ending per media type.
    endings = literal_map(
        {
            "image/jpeg": "jpg",
            "image/png": "png",
            "image/webp": "webp",
            "image/heic": "heic",
            "application/pdf": "pdf",
        }
    )
    safe = F.regexp_replace(media_id, r"[^a-zA-Z0-9._-]", "_")
    name = F.when(safe == "", "bill").otherwise(safe)
    ending = F.coalesce(endings[mime], F.lit("jpg"))
    return F.concat_ws(
        "/", business_id, F.date_format(uploaded_at, "yyyy/MM"), F.concat_ws(".", name, ending)
    )


def amount_line(text: Column, amount: Column) -> Column:
    """First trimmed line that shows the amount, as two decimals or as plain number."""
    lines = F.transform(F.split(text, r"\r?\n"), strip)
    shows = F.filter(
        lines, lambda l: F.contains(l, two_decimals(amount)) | F.contains(l, number_text(amount))
    )
    return F.when(amount.isNotNull(), F.get(shows, F.lit(0)))
