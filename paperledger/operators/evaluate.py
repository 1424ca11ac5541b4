"""Scoring extractions against labels, and sweeping the grading thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.functions import text as X
from paperledger.functions.values import gate_from, parse_amount, strip

# Targets of the pass criteria and the swept thresholds.
TARGETS = {"success": 0.70, "amount": 0.95, "date": 0.90, "vendor": 0.80, "gst": 1.0}
AMOUNT_GRID = [0.8, 0.85, 0.9, 0.95]
DATE_GRID = [0.75, 0.8, 0.85, 0.9, 0.95]
VENDOR_GRID = [0.6, 0.7, 0.75, 0.8, 0.9]

CHECKS = ["amount", "date", "vendor", "gst", "gst_basis", "abn", "invoice_number"]


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def check(expected: Column, actual: Column, kind: str) -> Column:
    """True, false, or null when the label expects nothing."""
    if kind in ("amount", "gst"):
        ok = F.abs(actual - expected) <= (0.005 if kind == "amount" else 0.01)
    elif kind == "vendor":
        a, e = _squeeze(actual), _squeeze(expected)
        ok = (a == e) | ((a != "") & (e != "") & (F.contains(a, e) | F.contains(e, a)))
    elif kind == "abn":
        ok = F.regexp_replace(F.lower(actual), r"\s+", "") == F.regexp_replace(expected, r"\s+", "")
    else:
        ok = actual == expected
    return F.when(expected.isNotNull(), F.coalesce(ok, F.lit(False)))


def score(joined: DataFrame) -> DataFrame:
    """Per-field checks and outcome of each labelled extraction.

    Input: ``id, should_log, hard, expected`` struct, ``extraction``, ``gate``,
    ``source``. The checks do not depend on thresholds; the outcome does.
    """
    e, x = F.col("expected"), F.col("extraction")
    actual = {c: x[c] if c == "gst_basis" else x[c]["value"] for c in CHECKS}
    checks = {f"ok_{c}": check(e[c], actual[c], c) for c in CHECKS}
    t = joined.select("*", *[v.alias(k) for k, v in checks.items()])
    wrong = [
        F.when(
            ~F.col(f"ok_{c}"),
            F.concat(
                F.lit(f"{c}: wanted "),
                e[c].cast("string"),
                F.lit(", read "),
                F.coalesce(actual[c].cast("string"), F.lit("nothing")),
            ),
        )
        for c in CHECKS
    ]
    low = F.when(F.col("gate") == "low", F.concat(F.lit("graded low from "), F.col("source")))
    return t.select(
        "*",
        success(F.col("gate")).alias("success"),
        not_auto_logged(F.col("gate")).alias("not_auto_logged"),
        F.array_compact(F.array(low, *wrong)).alias("reasons"),
    )


def success(gate: Column) -> Column:
    right = lambda c: F.coalesce(F.col(c), F.lit(True))
    return (gate != "low") & right("ok_amount") & right("ok_date")


def not_auto_logged(gate: Column) -> Column:
    return F.when(~F.col("should_log"), gate != "high")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def _measures(gate: Column, amount_high: Column, date_high: Column, vendor_high: Column) -> list[Column]:
    bill = F.col("should_log")
    good = success(gate)
    x = F.col("extraction")
    out = [
        F.count("*").alias("scored"),
        F.count_if(bill).alias("bills"),
        _share(F.count_if(bill & good), F.count_if(bill)).alias("success_rate"),
        F.count_if(bill & F.col("hard")).alias("hard_n"),
        _share(F.count_if(bill & F.col("hard") & good), F.count_if(bill & F.col("hard"))).alias("hard_rate"),
    ]
    for field, high in (("amount", amount_high), ("date", date_high), ("vendor", vendor_high)):
        pool = bill & F.col(f"ok_{field}").isNotNull() & (x[field]["confidence"] >= high)
        right = pool & F.col(f"ok_{field}")
        out += [
            F.count_if(pool).alias(f"{field}_n"),
            F.count_if(right).alias(f"{field}_correct"),
            _share(F.count_if(right), F.count_if(pool)).alias(f"{field}_accuracy"),
        ]
    out += [
        F.count_if(F.col("ok_gst").isNotNull()).alias("gst_n"),
        F.count_if(F.col("ok_gst")).alias("gst_correct"),
        *[F.count_if(gate == g).alias(f"gate_{g}") for g in ("high", "partial", "low")],
        F.count_if(~bill).alias("non_bills"),
        F.count_if(not_auto_logged(gate)).alias("non_bills_safe"),
    ]
    return out


def aggregate(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All metrics of one run in one row."""
    highs = [F.lit(v) for v in (settings.amount_high, settings.date_high, settings.vendor_high)]
    return scored.agg(*_measures(F.col("gate"), *highs))


def criteria(metrics: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per criterion: value, target, strict pass, and pass with n/a accepted."""
    t = {**TARGETS, **(targets or {})}
    exact_gst = (F.col("gst_n") > 0) & (F.col("gst_correct") == F.col("gst_n"))
    rows = []
    for name in TARGETS:
        value = {"success": F.col("success_rate"), "gst": _share(F.col("gst_correct"), F.col("gst_n"))}.get(
            name, F.col(f"{name}_accuracy") if name not in ("success", "gst") else None
        )
        met = exact_gst if name == "gst" else F.coalesce(value >= t[name], F.lit(False))
        rows.append(
            F.struct(
                F.lit(name).alias("criterion"),
                value.alias("value"),
                F.lit(t[name]).alias("target"),
                met.alias("pass"),
                (value.isNull() | met).alias("acceptable"),
            )
        )
    return metrics.select(F.inline(F.array(*rows)))


def grid(spark) -> DataFrame:
    """Every combination of the swept thresholds."""
    axis = lambda values, name: spark.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    )
    return (
        axis(AMOUNT_GRID, "amount_high")
        .crossJoin(axis(DATE_GRID, "date_high"))
        .crossJoin(axis(VENDOR_GRID, "vendor_high"))
    )


def sweep(scored: DataFrame, settings: Settings = DEFAULTS, targets: dict[str, float] | None = None) -> DataFrame:
    """Re-grade and re-pool every scored row under each threshold combination.

    Grades depend on a row only through the checks, the three confidences and
    what is missing, so rows are first counted per such profile. The grid of one
    hundred combinations then meets the few profiles instead of every row.
    """
    x = F.col("extraction")
    profile = scored.groupBy(
        "should_log",
        "hard",
        "ok_amount",
        "ok_date",
        "ok_vendor",
        "ok_gst",
        x["amount"]["value"].isNotNull().alias("has_amount"),
        x["amount"]["confidence"].alias("amount_conf"),
        x["date"]["value"].isNotNull().alias("has_date"),
        x["date"]["confidence"].alias("date_conf"),
        x["vendor"]["value"].isNotNull().alias("has_vendor"),
        x["vendor"]["confidence"].alias("vendor_conf"),
    ).agg(F.count("*").alias("weight"))
    present = lambda c: F.when(F.col(c), F.lit(1))
    graded = profile.crossJoin(F.broadcast(grid(scored.sparkSession))).withColumn(
        "gate",
        gate_from(
            present("has_amount"),
            F.col("amount_conf"),
            present("has_date"),
            F.col("date_conf"),
            present("has_vendor"),
            F.col("amount_high"),
            F.lit(settings.amount_low),
            F.col("date_high"),
        ),
    )
    bill, good = F.col("should_log"), success(F.col("gate"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0))
    measures = [
        _share(total(bill & good), total(bill)).alias("success_rate"),
        total(F.col("ok_gst").isNotNull()).alias("gst_n"),
        total(F.col("ok_gst")).alias("gst_correct"),
    ]
    for field in ("amount", "date", "vendor"):
        pool = bill & F.col(f"ok_{field}").isNotNull() & (F.col(f"{field}_conf") >= F.col(f"{field}_high"))
        measures.append(_share(total(pool & F.col(f"ok_{field}")), total(pool)).alias(f"{field}_accuracy"))
    combos = graded.groupBy("amount_high", "date_high", "vendor_high").agg(*measures)
    t = {**TARGETS, **(targets or {})}
    fine = lambda c, target: F.coalesce(F.col(c) >= target, F.lit(True))
    passed = fine("success_rate", t["success"]) & (
        (F.col("gst_n") == 0) | (F.col("gst_correct") == F.col("gst_n"))
    )
    for field in ("amount", "date", "vendor"):
        passed = passed & fine(f"{field}_accuracy", t[field])
    return combos.withColumn("pass", passed)


def recommend(combos: DataFrame) -> DataFrame:
    """The strictest passing combination, ties by success rate, then by the grid order."""
    strictness = F.round(F.col("amount_high") + F.col("date_high") + F.col("vendor_high"), 6)
    return (
        combos.filter("pass")
        .orderBy(
            strictness.desc(),
            F.coalesce("success_rate", F.lit(0.0)).desc(),
            F.col("amount_high"),
            F.col("date_high"),
            F.col("vendor_high"),
        )
        .limit(1)
    )


def match_labels(labels: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with their extraction, and the labels that have none."""
    return labels.join(extractions, "id"), labels.join(extractions.select("id"), "id", "left_anti")


def composition(labels: DataFrame) -> DataFrame:
    basis = F.col("expected.gst_basis")
    return labels.agg(
        *[F.count_if(basis == b).alias(b) for b in ("inclusive", "exclusive", "none")],
        *[F.count_if(F.col("orientation") == o).alias(o) for o in ("portrait", "landscape")],
        F.count_if("hard").alias("hard"),
    )


def date_guard(texts: DataFrame, text: str = "text") -> DataFrame:
    """Per text: number of date fragments, whether the guard had to catch them,
    and the amount a naive first-number reading would have leaked."""
    raw = strip(F.col(text))
    naive = F.regexp_extract(raw, rf"{X.START}\d+(?:\.\d{{1,2}})?{X.END}", 0)
    staged = texts.select("*", F.size(X.date_fragments(raw)).alias("fragments"))
    return staged.select(
        "*",
        ((F.col("fragments") > 0) & X.find_date(raw).isNull()).alias("guard_fired"),
        parse_amount(naive).alias("naive_leak"),
    )


def read_entries(extracted: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """What a run over texts without labels shows of each: grade, fields with confidence, date fragments, lines."""
    fields = ["amount", "date", "vendor", "abn", "gst", "invoice_number"]
    value = lambda f: F.struct(F.col(f"extraction.{f}.value").alias("value"), F.col(f"extraction.{f}.confidence").alias("confidence"))
    raw = strip(F.col(text))
    return date_guard(extracted, text).select(
        F.col(id_col).alias("id"),
        "gate",
        "source",
        F.struct(*[value(f).alias(f) for f in fields]).alias("fields"),
        X.date_fragments(raw).alias("date_fragments"),
        "guard_fired",
        "naive_leak",
        F.filter(F.split(raw, r"\r?\n"), lambda line: strip(line) != "").alias("raw_lines"),
    )


def guard_rate(guarded: DataFrame) -> DataFrame:
    return guarded.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("fragments") > 0).alias("with_fragments"),
        F.count_if("guard_fired").alias("guard_firings"),
        _share(F.count_if("guard_fired"), F.count("*")).alias("guard_fire_rate"),
    )


def gate_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Grade changes between two runs over the same ids."""
    b = before.select("id", F.col("gate").alias("before"))
    a = after.select("id", F.col("gate").alias("after"))
    both = b.join(a, "id", "full_outer")
    flip = ((F.col("before") == "high") & (F.col("after") == "low")) | (
        (F.col("before") == "low") & (F.col("after") == "high")
    )
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(F.coalesce(F.col("before") != F.col("after"), F.lit(False))).alias("changed"),
        F.count_if(flip).alias("flips"),
        F.count_if(F.col("before").isNull()).alias("only_after"),
        F.count_if(F.col("after").isNull()).alias("only_before"),
    )


def resolve_manifest(files: DataFrame, dirs: list[str], endings: list[str]) -> DataFrame:
    """First file per id by folder rank, then by ending rank."""
    rank = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    ranked = files.select("*", rank("dir", dirs).alias("dir_rank"), rank("ext", endings).alias("ext_rank"))
    ranked = ranked.filter("dir_rank > 0 and ext_rank > 0")
    # min_by combines per task, so an id with very many files stays cheap.
    best = F.min_by("path", F.struct("dir_rank", "ext_rank"))
    return ranked.groupBy("id").agg(best.alias("path"))

