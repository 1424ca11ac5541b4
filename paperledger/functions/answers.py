"""Stored answers of an outside reader, decoded into extraction structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperledger.functions.values import number_text

# Confidence per stated level.
LEVELS = {"high": 0.95, "medium": 0.7, "low": 0.4}


def pair(value: Column, confidence: Column) -> Column:
    return F.struct(
        value.alias("value"),
        F.when(value.isNull(), 0.0).otherwise(confidence).cast("double").alias("confidence"),
    )


def decode_json(answer: Column) -> Column:
    """Answer text to VARIANT, or null when it holds no readable JSON."""
    fences = F.btrim(F.regexp_replace(answer, r"(?i)```(?:json)?", ""), F.lit(" \t\n\r"))
    tidy = F.regexp_replace(F.replace(fences, F.lit("\\_"), F.lit("_")), r",\s*([}\]])", "$1")
    outer = F.regexp_extract(tidy, r"(?s)\A[^{]*(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(tidy), F.try_parse_json(F.nullif(outer, F.lit(""))))


def decode_answer(decoded: Column) -> Column:
    """Decoded answer to an extraction struct; null in, null out."""

    def text(name: str) -> Column:
        return F.nullif(F.try_variant_get(decoded, f"$.{name}", "string"), F.lit(""))

    level = text("confidence")
    confidence = F.lit(0.0)
    for name, value in LEVELS.items():
        confidence = F.when(level == name, value).otherwise(confidence)
    basis = text("gst_basis")
    amount = F.try_variant_get(decoded, "$.amount", "double")
    none = F.lit(None).cast("string")
    reading = F.struct(
        pair(amount, confidence).alias("amount"),
        pair(text("date"), confidence).alias("date"),
        pair(text("vendor"), confidence).alias("vendor"),
        pair(none, F.lit(0.0)).alias("vendor_resolved_to"),
        pair(text("abn"), confidence).alias("abn"),
        pair(F.lit(None).cast("double"), F.lit(0.0)).alias("gst"),
        F.when(basis.isin("inclusive", "exclusive", "none"), basis).otherwise("none").alias("gst_basis"),
        pair(text("invoice_number"), confidence).alias("invoice_number"),
        pair(text("due_date"), confidence).alias("due_date"),
        pair(text("category"), confidence).alias("category_hint"),
    )
    return F.when(decoded.isNotNull(), reading)


def only_printed(reading: Column, text: Column) -> Column:
    """Null an amount or date whose digits do not appear in the text."""
    printed = F.regexp_replace(text, r"\D", "")

    def checked(field: str, shown: Column) -> Column:
        digits = F.regexp_replace(shown, r"\D", "")
        known = F.contains(printed, digits)
        return F.when(known, reading[field]).otherwise(
            pair(F.lit(None).cast("double" if field == "amount" else "string"), F.lit(0.0))
        )

    out = reading.withField("amount", checked("amount", number_text(reading["amount"]["value"])))
    out = out.withField("date", checked("date", reading["date"]["value"]))
    return F.when(reading.isNotNull(), out)
