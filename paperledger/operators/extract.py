"""Bill extraction: a text column in, an extraction struct and its grade out.

Everything runs in one narrow stage; no rule needs a shuffle. The rules are laid
out as successive projections, so that a value used more than once is computed
once per row instead of being inlined into each use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.functions import text as X
from paperledger.functions import values as V
from paperledger.functions.answers import decode_answer, decode_json, only_printed, pair
from paperledger.functions.vendors import SEED_VENDORS, match_literal
from paperledger.plans.lineage import cut_lineage

_PREFIX = "__x_"


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(_PREFIX + n) for n, c in columns.items()])


def _c(name: str) -> Column:
    return F.col(_PREFIX + name)


def _drop_scratch(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_PREFIX)])


def read_fields(df: DataFrame, text: Column) -> DataFrame:
    """Add scratch columns with every raw field but the canonical vendor."""
    t = _add(df, text=V.plain_blanks(X.rejoin_wraps(F.coalesce(text, F.lit("")))))
    t = _add(t, low=F.lower(_c("text")))
    t = _add(
        t,
        date=X.find_date(_c("text")),
        nodate=X.strip_dates(_c("text")),
        abn=X.find_abn(_c("text")),
        basis=X.gst_basis(_c("text"), _c("low")),
        category=X.category_of(_c("text"), _c("low")),
    )
    # Taking out one date can join up another; a second pass is rarely needed.
    again = F.when(_c("nodate") == _c("text"), _c("nodate")).otherwise(X.strip_dates(_c("nodate")))
    t = _add(t, safe=again)
    t = _add(t, content=F.when(_c("safe").rlike(X.TOTAL_LINE), X.content_lines(_c("safe"))))
    t = _add(t, total=X.total_amount(_c("content"), _c("low")))
    t = _add(t, amounts=F.when(_c("total").isNull(), X.all_amounts(_c("safe"))))
    amount = F.coalesce(
        _c("total"),
        X.first_prefixed(_c("amounts")),
        X.words_amount(_c("safe"), _c("low")),
        X.first_readable(_c("amounts")),
    )
    t = _add(t, amount=amount)
    # Drop the first copy of the amount in either form, then of each currency word.
    t = _add(t, rem0=X.without_word_amounts(_c("nodate"), _c("low")))
    t = _add(t, money=V.two_decimals(_c("amount")), plain=V.number_text(_c("amount")))
    cut = lambda done, left: F.when(_c("amount").isNotNull(), done).otherwise(left)
    t = _add(t, before=cut(X.before_amount(_c("rem0"), _c("money")), F.lit(None)))
    t = _add(t, rem1=X.without_amount(_c("rem0"), _c("before"), _c("money")))
    t = _add(t, rem2=cut(X.without_number(_c("rem1"), _c("plain")), _c("rem1")))
    for i, (words, pattern) in enumerate(X.CURRENCY_PATTERNS, 2):
        left = _c(f"rem{i}")
        # Blanks take the place of what is cut, so no word comes up that the text doesn't hold.
        out = F.when(X.mentions(_c("low"), words), X.replace_first(left, pattern)).otherwise(left)
        t = _add(t, **{f"rem{i + 1}": cut(out, left)})
    t = _add(t, remainder=_c(f"rem{2 + len(X.CURRENCY_PATTERNS)}"))
    t = _add(t, stripped=X.without_category(_c("remainder"), _c("category")))
    rest = F.when(X.has_clean_word(_c("stripped")), _c("stripped")).otherwise(_c("remainder"))
    t = _add(t, rest=rest)
    # A column of its own: an expression inside the walk would split the text per line.
    t = _add(t, rest_lines=X.lines_of(_c("rest")))
    t = _add(t, block=X.vendor_block(X.lines_of(_c("nodate")), _c("rest_lines"), _c("low")))
    picked = F.when(_c("block") != "", _c("block")).otherwise(
        F.nullif(F.array_join(X.clean_words(_c("rest")), " "), F.lit(""))
    )
    return _add(t, picked=picked)


def _certain(value: Column) -> Column:
    return pair(value, F.lit(1.0))


def raw_reading(resolved: Column) -> Column:
    """Extraction struct of the text rules before normalisation."""
    nothing = F.lit(None)
    vendor = F.coalesce(resolved, _c("picked"))
    sure = F.when(resolved.isNotNull(), 0.9).otherwise(1.0)
    return F.struct(
        _certain(_c("amount")).alias("amount"),
        _certain(_c("date")).alias("date"),
        pair(vendor, sure).alias("vendor"),
        pair(resolved, F.lit(0.9)).alias("vendor_resolved_to"),
        _certain(_c("abn")).alias("abn"),
        _certain(nothing.cast("double")).alias("gst"),
        _c("basis").alias("gst_basis"),
        _certain(nothing.cast("string")).alias("invoice_number"),
        _certain(nothing.cast("string")).alias("due_date"),
        _certain(_c("category")).alias("category_hint"),
    )


def read_text(
    df: DataFrame, text: Column, into: str = "reading", vendors: list[str] | None = None
) -> DataFrame:
    """Run the text rules only: no normalisation, no grading."""
    known = SEED_VENDORS if vendors is None else vendors
    t = read_fields(df, text)
    t = _add(t, resolved=match_literal(_c("picked"), known))
    return _drop_scratch(t.select("*", raw_reading(_c("resolved")).alias(into)))


def normalise(reading: Column, registered: Column) -> Column:
    """Round, validate and blank out the fields of a raw extraction struct."""

    def keep(name: str, value: Column) -> Column:
        return pair(value, reading[name]["confidence"]).alias(name)

    amount = V.round2(reading["amount"]["value"])
    abn = reading["abn"]["value"]
    abn_kept = F.when(
        (reading["abn"]["confidence"] >= 0.8) & V.abn_ok(abn), F.regexp_replace(abn, r"\s+", " ")
    )
    gst = V.compute_gst(amount, reading["gst_basis"], registered)
    blank = lambda name: V.blank_to_null(reading[name]["value"])
    return F.struct(
        keep("amount", amount),
        keep("date", V.normalise_date(reading["date"]["value"])),
        keep("vendor", blank("vendor")),
        keep("vendor_resolved_to", blank("vendor_resolved_to")),
        keep("abn", abn_kept),
        _certain(gst).alias("gst"),
        reading["gst_basis"].alias("gst_basis"),
        keep("invoice_number", V.clean_invoice(reading["invoice_number"]["value"])),
        keep("due_date", V.normalise_date(reading["due_date"]["value"])),
        keep("category_hint", blank("category_hint")),
    )


def extract_bills(
    df: DataFrame,
    *,
    text: Column | None = None,
    ocr_text: Column | None = None,
    registered: Column | None = None,
    vendors: list[str] | DataFrame | None = None,
    scope: str | None = None,
    text_answer: Column | None = None,
    image_answer: Column | None = None,
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add ``extraction``, ``gate``, ``machine_read`` and ``source``; input columns of these names are replaced.

    Scanned text comes before typed text. ``vendors`` is a short list or, for
    learned names, a DataFrame with a ``vendor`` column (and the ``scope`` column
    the names belong to, if given). ``text_answer`` and ``image_answer`` are
    columns of stored answers. ``fallback`` gets a DataFrame with the column
    ``ask``, null on every row that needs no answer, and adds ``text_answer``.
    """
    null_text = F.lit(None).cast("string")
    ocr = null_text if ocr_text is None else ocr_text
    typed = null_text if text is None else text
    has_ocr = F.coalesce(V.strip(ocr) != "", F.lit(False))
    has_typed = F.coalesce(V.strip(typed) != "", F.lit(False))
    start = _add(
        df,
        ocr=has_ocr,
        source=F.when(has_ocr, "ocr").when(has_typed, "regex").otherwise("none"),
        input=F.when(has_ocr, ocr).when(has_typed, typed),
        registered=F.lit(True) if registered is None else F.coalesce(registered, F.lit(True)),
        text_answer=null_text if text_answer is None else text_answer,
        image_answer=null_text if image_answer is None else image_answer,
    )
    t = read_fields(start, _c("input"))

    if isinstance(vendors, DataFrame):
        from paperledger.operators.vendors import resolve_vendors

        # The picked names feed both sides of several joins: read the text once,
        # and keep only what the answers and the result still need.
        needed = ["ocr", "source", "registered", "text_answer", "image_answer", "amount", "date", "abn", "basis", "category", "picked"]
        if text_answer is not None or image_answer is not None or fallback is not None:
            needed.append("input")
        t = cut_lineage(t.select(*[F.col(f"`{c}`") for c in df.columns], *[_PREFIX + c for c in needed]))
        t = resolve_vendors(t, _PREFIX + "picked", vendors, scope=scope, into=_PREFIX + "resolved")
    else:
        known = SEED_VENDORS if vendors is None else vendors
        t = _add(t, resolved=match_literal(_c("picked"), known))

    wants_text = _c("ocr") & _c("amount").isNull()
    if fallback is not None:
        asked = t.select("*", F.when(wants_text, _c("input")).alias("ask"))
        answered = fallback(asked)
        t = answered.withColumn(_PREFIX + "text_answer", F.col("text_answer")).drop("ask", "text_answer")

    # Readings in order of precedence; a source that is not in use costs nothing.
    readings, answered = [raw_reading(_c("resolved"))], F.lit(False)
    if text_answer is not None or fallback is not None:
        t = _add(t, by_text=decode_json(F.when(wants_text, _c("text_answer"))))
        t = _add(t, text_reading=decode_answer(_c("by_text")))
        readings.insert(0, only_printed(_c("text_reading"), _c("input")))
        answered = answered | _c("by_text").isNotNull()
    if image_answer is not None:
        wants_image = (_c("source") == "none") | (_c("ocr") & X.is_garbage(_c("input")))
        asked = F.when(_c("image_answer").isNotNull(), F.when(wants_image, _c("image_answer")))
        t = _add(t, by_image=decode_json(asked))
        readings.insert(0, decode_answer(_c("by_image")))
        answered = answered | _c("by_image").isNotNull()
    final_source = F.when(answered, "ai").otherwise(_c("source"))
    t = _add(t, raw=F.coalesce(*readings), final_source=final_source)
    t = _add(t, extraction=normalise(_c("raw"), _c("registered")))
    result = F.struct(
        _c("extraction").alias("extraction"),
        V.gate(_c("extraction"), settings).alias("gate"),
        (_c("final_source") != "ai").alias("machine_read"),
        _c("final_source").alias("source"),
    )
    # The generator keeps a filter on the results from being pushed into the
    # rules, where it would run all of them a second time.
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("extraction", "gate", "machine_read", "source")]
    return t.select(*kept, F.inline(F.array(result)))
