"""Reports of sweeps and of unlabelled runs, corrections in batch, rows of one viewer."""

import json

from pyspark.sql import functions as F

from paperledger.functions.values import gate
from paperledger.operators import evaluate as E
from paperledger.operators import ledger as L
from paperledger.operators import reports as R
from paperledger.operators.extract import extract_bills
from paperledger.schemas import empty_extraction
from paperledger.sources import writers

COMBO = "amount_high double, date_high double, vendor_high double, success_rate double, pass boolean"


def _read(spark, folder):
    return json.loads("".join(r["value"] for r in spark.read.text(str(folder)).collect()))


def test_sweep_report_reads_back(spark, tmp_path):
    corpus = spark.createDataFrame([(12, 10, 2)], "total long, scored long, skipped long")
    combos = spark.createDataFrame([(0.9, 0.85, 0.75, 0.8, False), (0.95, 0.75, 0.6, 0.7, True), (0.8, 0.75, 0.6, None, True)], COMBO)
    writers.write_report(writers.sweep_report(combos, corpus), str(tmp_path / "some"))
    back = _read(spark, tmp_path / "some")
    assert back["corpus"] == {"total": 12, "scored": 10, "skipped": 2} and back["targets"]["amount"] == 0.95
    assert back["defaults"] == {"thresholds": {"amount_high": 0.9, "date_high": 0.85, "vendor_high": 0.75}, "pass": False}
    assert back["passing_count"] == 2 and back["recommended"] == {"amount_high": 0.95, "date_high": 0.75, "vendor_high": 0.6}
    assert [c["amount_high"] for c in back["combos"]] == [0.8, 0.9, 0.95] and "success_rate" not in back["combos"][0]


def test_sweep_report_without_a_passing_point_or_any(spark):
    corpus = spark.createDataFrame([(0,)], "total long")
    combos = spark.createDataFrame([(0.9, 0.85, 0.75, 0.1, False)], COMBO)
    (none,) = writers.sweep_report(combos, corpus).collect()
    assert none["recommended"] is None and none["passing_count"] == 0 and len(none["combos"]) == 1
    (empty,) = writers.sweep_report(combos.limit(0), corpus).collect()
    assert empty["combos"] == [] and empty["defaults"]["pass"] is False


def test_report_of_texts_without_labels(spark, tmp_path):
    texts = [("a", "Corner Cafe\n10/08/2026\n\nTotal $25.50"), ("b", "for 31 at 9:15"), ("c", ""), ("d", None)]
    out = extract_bills(spark.createDataFrame(texts, "id string, text string"), ocr_text=F.col("text"))
    entries = E.read_entries(out)
    writers.write_read_report(entries, str(tmp_path))
    summary = _read(spark, tmp_path / "summary")
    assert summary["texts"] == 4 and summary["date_guard"]["with_fragments"] == 2 and summary["date_guard"]["guard_firings"] == 1
    assert summary["date_guard"]["guard_fire_rate"] == 0.25 and sum(summary["gating"].values()) == 4
    back = {r["id"]: r for r in spark.read.json(str(tmp_path / "entries")).collect()}
    assert back["a"]["raw_lines"] == ["Corner Cafe", "10/08/2026", "Total $25.50"] and back["a"]["date_fragments"] == ["10/08/2026"]
    assert back["a"]["fields"]["amount"]["value"] == 25.5 and not back["a"]["guard_fired"]
    assert back["b"]["guard_fired"] and back["b"]["naive_leak"] == 31.0 and back["c"]["raw_lines"] == []
    assert E.read_entries(out.limit(0)).collect() == [] and writers.read_summary(E.read_entries(out.limit(0))).head()["date_guard"]["guard_fire_rate"] is None


def test_corrections_bring_tax_and_grade(spark):
    x = empty_extraction().withField("gst_basis", F.lit("inclusive"))
    drafts = spark.range(7).select("id", F.when(F.col("id") != 6, x).alias("extraction"), F.when(F.col("id") != 0, F.col("id") != 2).alias("gst_registered"), F.lit("low").alias("gate"))
    edits = [
        (0, 1, "amount", "110"), (0, 2, "vendor", " Shop Oak "), (0, 3, "date", "1/2/2026"),
        (1, 1, "amount", "110"), (1, 2, "amount", "much"), (1, 3, "amount", "$ 55.00"),
        (2, 1, "amount", "110"), (3, 1, "vendor", ""), (3, 2, "vendor", "x" * 61), (4, 5, "date", "2026-02-30"),
        (6, 1, "amount", "9"), (6, 2, "vendor", "y" * 60), (99, 1, "amount", "1"),
    ]
    frame = spark.createDataFrame(edits, "id long, edited_at int, field string, text string")
    got = {r["id"]: r for r in L.apply_edits(drafts, frame).collect()}
    value = lambda k, f: got[k]["extraction"][f]["value"]
    assert sorted(got) == list(range(7))
    assert (value(0, "amount"), value(0, "gst"), value(0, "vendor"), value(0, "date"), got[0]["gate"]) == (110.0, 10.0, "Shop Oak", "2026-02-01", "high")
    assert (value(1, "amount"), value(1, "gst"), got[1]["gate"]) == (55.0, 5.0, "partial")
    assert value(2, "amount") == 110.0 and value(2, "gst") is None and got[2]["extraction"]["gst"]["confidence"] == 1.0
    assert all(value(k, "vendor") is None and got[k]["gate"] == "low" for k in (3, 4, 5))
    assert value(6, "amount") == 9.0 and value(6, "gst") is None and value(6, "vendor") == "y" * 60  # nothing was read before
    assert L.apply_edits(drafts, frame.limit(0)).filter("gate <> 'low'").count() == 0 and L.apply_edits(drafts.limit(0), frame).count() == 0


def test_grade_of_an_empty_extraction(spark):
    assert spark.range(1).select(gate(empty_extraction())).head()[0] == "low"


def test_rows_of_one_viewer_come_once(spark):
    bills = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 10), (4, 2, 12), (5, None, 10), (6, 3, None)], "bill_id int, business_id int, user_id int")
    members = spark.createDataFrame([(1, 10, "owner"), (1, 10, "owner"), (1, 11, "staff"), (2, 10, "staff"), (2, 12, "owner")], "business_id int, user_id int, role string")
    seen = lambda who: sorted(r["bill_id"] for r in R.bills_of_viewer(bills, members, F.lit(who)).collect())
    assert seen(10) == [1, 2, 3, 5] and seen(11) == [2] and seen(12) == [3, 4] and seen(99) == []
