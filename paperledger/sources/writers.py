"""Sinks: the accountant extract, evaluation reports, archived bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.functions.values import day_key, two_decimals
from paperledger.operators.evaluate import TARGETS, recommend

# Header of the accountant extract.
EXTRACT_HEADER = [
    "Logged",
    "Bill date",
    "Vendor",
    "Vendor resolved to",
    "Category",
    "Amount",
    "GST",
    "GST basis",
    "Invoice",
    "ABN",
    "Source",
    "Gate",
]


def extract_columns(bills: DataFrame) -> DataFrame:
    """The twelve columns of the accountant extract, all as text, missing ones empty."""
    values = [
        day_key(F.col("confirmed_at")),
        F.col("date"),
        F.col("vendor"),
        F.col("vendor_resolved_to"),
        F.col("category"),
        two_decimals(F.col("amount").cast("double")),
        two_decimals(F.col("gst").cast("double")),
        F.col("gst_basis"),
        F.col("invoice_number"),
        F.col("abn"),
        F.when(F.col("auto_logged"), "auto").otherwise("manual"),
        F.col("gate_level"),
    ]
    money = {"Amount": "amount", "GST": "gst"}
    out = []
    for name, value in zip(EXTRACT_HEADER, values):
        if name in money:
            value = F.when(F.col(money[name]).isNotNull(), value)
        out.append(F.coalesce(value, F.lit("")).alias(name))
    return bills.select(*out)


def csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def csv_lines(bills: DataFrame) -> DataFrame:
    """One finished CSV line per bill."""
    flat = extract_columns(bills)
    return flat.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in EXTRACT_HEADER]).alias("line"))


def write_extract(bills: DataFrame, folder: str) -> None:
    """CSV with a byte-order mark, header and CRLF ends; every part file is complete."""
    flat = extract_columns(bills)
    marked = flat.withColumnRenamed(EXTRACT_HEADER[0], "\ufeff" + EXTRACT_HEADER[0])
    # Cells are written as they are, blanks at their ends too.
    marked.write.mode("overwrite").csv(
        folder, header=True, lineSep="\r\n", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def extract_name(month: Column, category: Column, vendor: Column) -> Column:
    """``bills[-month][-category][-vendor].csv``"""
    clean = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9-]+", "-"))
    given = lambda c: F.nullif(c, F.lit(""))
    parts = F.concat_ws("-", F.lit("bills"), given(month), clean(given(category)), clean(given(vendor)))
    return F.concat(parts, F.lit(".csv"))


def write_report(metrics: DataFrame, folder: str) -> None:
    """A report as JSON documents, nested columns kept."""
    metrics.write.mode("overwrite").json(folder)


def run_report(metrics: DataFrame, criteria: DataFrame, histogram: DataFrame) -> DataFrame:
    """One nested row per run: metrics, criteria list and grade histogram."""
    listed = criteria.agg(F.sort_array(F.collect_list(F.struct("criterion", "value", "target", "pass"))).alias("criteria"))
    packed = metrics.select(F.struct(*metrics.columns).alias("metrics"))
    return packed.crossJoin(listed).crossJoin(histogram.select(F.struct(*histogram.columns).alias("gating")))


def sweep_report(combos: DataFrame, corpus: DataFrame, defaults: Settings = DEFAULTS, targets: dict[str, float] | None = None) -> DataFrame:
    """One nested row per sweep: corpus, targets, the defaults and whether they pass, all combinations, the recommended one.

    ``combos`` is the result of ``sweep``, which has a row for each point of the
    grid whatever it was counted from; ``corpus`` one row of counts.
    """
    axes = ["amount_high", "date_high", "vendor_high"]
    point = F.struct(*axes)
    standard = F.struct(*[F.lit(getattr(defaults, a)).alias(a) for a in axes])
    best = recommend(combos).select(F.struct(*axes).alias("recommended"))
    whole = combos.agg(
        F.struct(standard.alias("thresholds"), F.coalesce(F.bool_or((point == standard) & F.col("pass")), F.lit(False)).alias("pass")).alias("defaults"),
        F.sort_array(F.collect_list(F.struct(*axes, *[c for c in combos.columns if c not in axes]))).alias("combos"),
        F.count_if("pass").alias("passing_count"),
    )
    goals = F.struct(*[F.lit(v).alias(k) for k, v in {**TARGETS, **(targets or {})}.items()])
    left = corpus.select(F.struct(*corpus.columns).alias("corpus"), goals.alias("targets")).crossJoin(whole)
    # Nothing passes: the row stays, without a recommendation.
    return left.join(best, F.lit(True), "left")


def read_summary(entries: DataFrame) -> DataFrame:
    """One row over ``read_entries``: texts, how often the date guard had to act, grades."""
    n, fragments = F.count("*"), F.count_if(F.size("date_fragments") > 0)
    guard = F.struct(fragments.alias("with_fragments"), F.count_if("guard_fired").alias("guard_firings"), F.try_divide(F.count_if("guard_fired").cast("double"), n).alias("guard_fire_rate"))
    grades = F.struct(*[F.count_if(F.col("gate") == g).alias(g) for g in ("high", "partial", "low")])
    return entries.agg(n.alias("texts"), guard.alias("date_guard"), grades.alias("gating"))


def write_read_report(entries: DataFrame, folder: str) -> None:
    """The summary below ``summary``, and a JSON document for each text below ``entries``, from as many tasks as there are parts."""
    write_report(entries, f"{folder}/entries")
    write_report(read_summary(entries), f"{folder}/summary")
