"""Literal cases for the value rules, each run as one Spark job."""

import pytest
from pyspark.sql import functions as F

from paperledger.config import Settings
from paperledger.functions import values as V


def run(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_business_number(spark):
    cases = {
        "51 824 753 556": True,
        "51824753556": True,
        "12 345 678 901": False,
        "123": False,
        "00000000000": False,
    }
    got = run(spark, [(k,) for k in cases], "a string", ok=V.abn_ok(F.col("a")))
    assert [g[0] for g in got] == list(cases.values())


def test_dates(spark):
    cases = {
        "10/08/2026": "2026-08-10",
        "10-Aug-2026": "2026-08-10",
        "2026-08-10": "2026-08-10",
        "2026-8-1": "2026-08-01",
        "31/02/2026": None,
        "29/02/2024": "2024-02-29",
        "29/02/2023": None,
        "not a date": None,
        "03-08-2026": "2026-08-03",
        "26.08.2026": "2026-08-26",
        "3/8/26": "2026-08-03",
        "10-Aug-26": "2026-08-10",
        "08-10-26": "2026-10-08",
        "1/1/49": "2049-01-01",
        "1/1/50": "1950-01-01",
        "09 / 05 / 2009": "2009-05-09",
        "09. 05. 2009": "2009-05-09",
        "09 May 2009": "2009-05-09",
        "9 September 2009": "2009-09-09",
        "09 May 09": "2009-05-09",
        "09 Foo 2009": None,
        "0050-01-01": None,
        "1/1/123": None,
        "": None,
    }
    got = run(spark, [(k,) for k in cases], "a string", d=V.normalise_date(F.col("a")))
    assert dict(zip(cases, [g[0] for g in got])) == cases


def test_amounts(spark):
    cases = {
        "$4,850.00": 4850.0,
        "AUD 4850": 4850.0,
        "1,234.56": 1234.56,
        "500": 500.0,
        "245.5": 245.5,
        "Rs 321.68": 321.68,
        "Rs. 10": 10.0,
        "₹ 1,00": None,
        "1.234": None,
        "abc": None,
        "": None,
        "$,": None,
        "9" * 400: None,
    }
    got = run(spark, [(k,) for k in cases], "a string", d=V.parse_amount(F.col("a")))
    assert dict(zip(cases, [g[0] for g in got])) == cases


def test_rounding_and_gst(spark):
    rows = [(8.325, "inclusive", True), (245.0, "inclusive", True), (245.0, "exclusive", True), (245.0, "none", True), (245.0, "inclusive", False)]
    got = run(
        spark,
        rows,
        "a double, b string, r boolean",
        r=V.round2(F.col("a")),
        g=V.compute_gst(F.col("a"), F.col("b"), F.col("r")),
    )
    assert [g[0] for g in got][:2] == [8.32, 245.0]
    assert [g[1] for g in got] == [0.76, 22.27, 24.5, None, None]


def test_invoice_numbers(spark):
    cases = {"0" * 20: None, "INV-99211": "INV-99211", "  ": None, " A1 ": "A1", "111111111": "111111111"}
    got = run(spark, [(k,) for k in cases], "a string", d=V.clean_invoice(F.col("a")))
    assert dict(zip(cases, [g[0] for g in got])) == cases


@pytest.mark.parametrize(
    "amount,aconf,date,dconf,vendor,expected",
    [
        (245.0, 0.97, "2026-08-10", 0.95, "Telstra", "high"),
        (245.0, 0.97, "2026-08-10", 0.95, None, "partial"),
        (245.0, 0.97, "2026-08-10", 0.5, "Telstra", "partial"),
        (245.0, 0.75, "2026-08-10", 0.95, "Telstra", "partial"),
        (245.0, 0.4, "2026-08-10", 0.95, "Telstra", "low"),
        (None, 0.0, "2026-08-10", 0.95, "Telstra", "low"),
    ],
)
def test_gate(spark, amount, aconf, date, dconf, vendor, expected):
    schema = "a double, ac double, d string, dc double, v string"
    column = V.gate_from(*[F.col(c) for c in ("a", "ac", "d", "dc", "v")], F.lit(0.9), F.lit(0.7), F.lit(0.85))
    assert run(spark, [(amount, aconf, date, dconf, vendor)], schema, g=column) == [(expected,)]


def test_text_forms(spark):
    got = run(
        spark,
        [(1234.5,), (-3.0,), (245.0,), (12345678.9,)],
        "a double",
        money=V.format_aud(F.col("a")),
        short=V.number_text(F.col("a")),
    )
    assert got == [("$1,234.50", "1234.5"), ("-$3.00", "-3"), ("$245.00", "245"), ("$12,345,678.90", "12345678.9")]


def test_paths_and_lists(spark):
    got = run(
        spark,
        [("b1", "2026-08-03 10:00:00", "wamid/1+2", "image/png", '["u1","u2"]'), ("b1", "2026-08-03 10:00:00", "", "x", "{bad")],
        "b string, t string, m string, k string, j string",
        path=V.archive_path(F.col("b"), F.col("t").cast("timestamp"), F.col("m"), F.col("k")),
        urls=V.decode_list(F.col("j")),
    )
    assert got == [("b1/2026/08/wamid_1_2.png", ["u1", "u2"]), ("b1/2026/08/bill.jpg", [])]


def test_amount_line(spark):
    text = "Shop\n  Total $267.30 \n267.3 again"
    got = run(spark, [(text, 267.3), (text, None), (text, 9.0)], "t string, a double", l=V.amount_line(F.col("t"), F.col("a")))
    assert got == [("Total $267.30",), (None,), (None,)]


def test_settings_overrides():
    s = Settings.from_overrides({"amount_high": "0.8", "draft_minutes": "7.5", "date_high": "oops"})
    assert (s.amount_high, s.draft_minutes, s.date_high) == (0.8, 8, 0.85)
