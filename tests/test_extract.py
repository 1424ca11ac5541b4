"""Sources, stored answers, fallback step and learned names of the extraction job."""

import json

import pytest
from pyspark.sql import functions as F

from paperledger.operators.extract import extract_bills, read_text

def test_learned_names_as_list_and_as_frame(spark):
    df = spark.createDataFrame([("MORA AND COUSINS ROOFINQ\nTotal $410.00",)], "t string")
    names = ["mora and cousins roofing"]
    short = read_text(df, F.col("t"), vendors=names).head()["reading"]
    frame = spark.createDataFrame([(n,) for n in names], "vendor string")
    joined = extract_bills(df, text=F.col("t"), vendors=frame).head()["extraction"]
    for reading in (short, joined):
        assert reading["vendor"]["value"] == "mora and cousins roofing"
        assert reading["vendor"]["confidence"] == 0.9
        assert reading["vendor_resolved_to"]["value"] == "mora and cousins roofing"


ANSWER = {"amount": 245.0, "vendor": "Telstra", "date": "10/08/2026", "abn": None, "gst_basis": "inclusive", "category": "utilities", "confidence": "high"}


def _sources(spark, rows):
    df = spark.createDataFrame(rows, "i int, text string, ocr string, ta string, ia string")
    out = extract_bills(
        df, text=F.col("text"), ocr_text=F.col("ocr"), text_answer=F.col("ta"), image_answer=F.col("ia")
    )
    return {r["i"]: r for r in out.collect()}


def test_sources_and_answers(spark):
    plain = json.dumps(ANSWER)
    fenced = "Sure!\n```json\n" + plain.replace("gst_basis", "gst\\_basis").replace('"high"}', '"high",}') + "\n```\nDone"
    made_up = json.dumps({**ANSWER, "amount": 999.0})
    noise = "ux ol re Qa vi do 9 em ta li ro Su pe no wa xi 77"
    shown = "Telstra no total 24 5 of 10/08/2026"
    rows = [
        (1, "$245.00 10/08/2026 Telstra", None, plain, plain),
        (2, None, "total 245 here: x245x 10/08/2026", plain, None),
        (3, None, "nothing here", fenced, None),
        (4, None, "two4five 245x and 10082026x", fenced, None),
        (5, None, "amount 999", "not json", None),
        (6, None, None, None, plain),
        (7, None, None, None, "broken"),
        (8, None, noise, plain, made_up),
        (9, None, noise, plain, "broken"),
        (10, " ", "", None, None),
        (11, None, "x245x 10082026x", made_up, None),
    ]
    got = _sources(spark, rows)
    assert [got[i]["source"] for i in (1, 6, 7, 10)] == ["regex", "ai", "none", "none"]
    assert got[1]["machine_read"] and not got[6]["machine_read"]
    assert got[1]["gate"] == "high" and got[7]["gate"] == "low"
    # A readable text amount keeps the text reading.
    assert got[2]["source"] == "ocr" and got[2]["extraction"]["amount"]["value"] == 245.0
    # Digits that the text does not show are dropped.
    assert got[3]["source"] == "ai" and got[3]["extraction"]["amount"]["value"] is None
    assert got[3]["gate"] == "low"
    assert got[4]["extraction"]["amount"]["value"] == 245.0
    assert got[4]["extraction"]["date"]["value"] == "2026-08-10"
    assert got[4]["extraction"]["gst"]["value"] == 22.27
    assert got[4]["gate"] == "high" and not got[4]["machine_read"]
    assert got[5]["source"] == "ocr"
    # The image answer beats everything on garbage text, and is not checked.
    assert got[8]["source"] == "ai" and got[8]["extraction"]["amount"]["value"] == 999.0
    assert got[9]["source"] == "ocr" and got[9]["extraction"]["amount"]["value"] == 77.0
    assert got[11]["extraction"]["amount"]["value"] is None
    assert shown


def test_fallback_step_sees_only_needy_rows(spark):
    seen = []

    def answer(df):
        def step(batches):
            for pdf in batches:
                pdf["text_answer"] = [None if a is None else json.dumps(ANSWER) for a in pdf["ask"]]
                yield pdf

        from pyspark.sql import types as T

        seen.append(df.columns)
        schema = T.StructType([f for f in df.schema.fields] + [T.StructField("text_answer", T.StringType())])
        return df.mapInPandas(step, schema)

    df = spark.createDataFrame([(1, "x245x 10082026x"), (2, "Total $10.00")], "i int, t string")
    out = extract_bills(df, ocr_text=F.col("t"), fallback=answer)
    got = {r["i"]: r for r in out.collect()}
    assert got[1]["source"] == "ai" and got[2]["source"] == "ocr"
    assert "ask" in seen[0] and out.columns == ["i", "t", "extraction", "gate", "machine_read", "source"]


def test_unregistered_business_has_no_gst(spark):
    df = spark.createDataFrame([("Shop\nTotal $110.00 GST inclusive", True), ("Shop\nTotal $110.00 GST inclusive", False)], "t string, r boolean")
    out = extract_bills(df, text=F.col("t"), registered=F.col("r")).collect()
    assert [r["extraction"]["gst"]["value"] for r in out] == [10.0, None]


def test_clashing_input_columns_are_replaced(spark):
    df = spark.createDataFrame([("rent 120 lee", "theirs", "old")], "t string, source string, gate string")
    out = extract_bills(df, text=F.col("t"))
    assert out.columns == ["t", "extraction", "gate", "machine_read", "source"] and out.head()["source"] == "regex"


def test_learned_names_keep_a_narrow_checkpoint(spark, monkeypatch):
    from paperledger.operators import extract

    class Seen(Exception):
        pass

    def look(df):
        raise Seen(df.columns)

    monkeypatch.setattr(extract, "cut_lineage", look)
    known = spark.createDataFrame([("mora roofing",)], "vendor string")
    with pytest.raises(Seen) as caught:
        extract_bills(spark.createDataFrame([("rent 120 lee",)], "t string"), text=F.col("t"), vendors=known)
    (columns,) = caught.value.args
    assert len(columns) == 12 and not [c for c in columns if "rem" in c or "input" in c or "rest" in c]


LABELS = [
    ("own1", "image", "Quill & Daughters\nDate: 2023-11-30\nTotal $1,204.40\nGST inclusive", {"amount": 1204.4, "date": "2023-11-30", "gst": 109.49, "gst_basis": "inclusive"}, True),
    ("own2", "image", "ninety nine dollars only", {"amount": 99.0}, True),
    ("own3", "text", "Paddock 12.12.2023 AUD 66 plus gst", {"amount": 66.0, "date": "2023-12-12", "vendor": "Paddock", "gst": 6.6, "gst_basis": "exclusive"}, True),
    ("own4", "text", "rent 1900", {"amount": 1900.0}, True),
    ("own5", "text", "can you call me back tonight", {}, False),
]


def test_labels_from_folder_to_report(spark, tmp_path):
    """All fields of our own labels are read; the report keeps metrics, criteria and grades nested."""
    from paperledger.operators import evaluate as E
    from paperledger.sources import readers, writers

    for name, kind, words, expected, bill in LABELS:
        label = {"id": name, "kind": kind, ("text" if kind == "text" else "ocr_text"): words, "source": "own", "should_log": bill, "hard": name == "own2", "expected": expected}
        (tmp_path / f"{name}.json").write_text(json.dumps(label))
    labels, bad = readers.read_labels(spark, str(tmp_path))
    scored = E.score(extract_bills(labels, text=F.col("text"), ocr_text=F.col("ocr_text")))
    metrics = E.aggregate(scored)
    m = metrics.head()
    assert bad.count() == 0 and (m["bills"], m["success_rate"], m["hard_rate"], m["non_bills"], m["non_bills_safe"]) == (4, 1.0, 1.0, 1, 1)
    assert [m[f"{f}_correct"] == m[f"{f}_n"] for f in ("amount", "date", "vendor", "gst")] == [True] * 4 and m["gst_n"] == 2
    grades = metrics.select(F.col("gate_high").alias("high"), F.col("gate_partial").alias("partial"), F.col("gate_low").alias("low"))
    writers.write_report(writers.run_report(metrics, E.criteria(metrics), grades), str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report")).head()
    assert all(c["pass"] for c in back["criteria"]) and back["gating"]["low"] == 1
