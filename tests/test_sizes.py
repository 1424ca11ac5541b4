"""Queries on tables whose keys or sizes go beyond those of the given ones."""

import random
import re
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperledger.functions import text as X
from paperledger.functions import values as V
from paperledger.operators import lookup as LO
from paperledger.operators import pipeline as P
from paperledger.operators import reports as R
from paperledger.operators import totals as TO
from paperledger.operators import vendors as N
from paperledger.plans import queries as Q
from paperledger.plans import views as VW
from paperledger.sources import readers
from tools.check import rows_of, same

T0 = datetime(2024, 1, 1)


def twin_agrees(spark, folder, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = db.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_reloaded_seed_with_ids_beyond_a_million(spark, tmp_path):
    """Whether a row is the seed's is no matter of how large its id is."""
    ids = [*range(995, 1010), *range(999_995, 1_000_010), *range(2_001_000, 2_001_010)]
    rows = [(i, T0 + timedelta(seconds=i), 7 if i % 2 else 8, "click", 1.0, None) for i in ids]
    names = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "events.parquet"))
    twin_agrees(spark, tmp_path, "reloaded_seed", ["events"])


def test_first_copy_of_an_amount_goes_without_a_pattern_per_row(spark):
    """The plain search takes out what the pattern of the amount would; patterns that differ per row are compiled per row."""
    rng = random.Random(3)
    bits = ["45.20", "$", " ", "\n", "$45.20", "$ 45.20", "x", "4", "145.20", "45.2", "$$", "\t"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 7))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", F.lit("45.20").alias("money"))
    got = df.select("text", X.without_amount(F.col("text"), X.before_amount(F.col("text"), F.col("money")), F.col("money")).alias("left"))
    want = [re.sub(r"\$?[ \t\n]?45\.20", " ", x, count=1) for x in texts]
    assert [r["left"] for r in got.collect()] == want


def test_rules_are_not_computed_twice_inside_arrays(spark):
    """``parse_amount`` holds its patterns once: each more copy is run again for every amount of a text."""
    plan = spark.range(1).select(V.parse_amount(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1


def test_a_payload_is_parsed_once(spark):
    """Each copy of the parser in the plan parses every message again."""
    raw = spark.createDataFrame([("{}",)], "value string")
    plan = readers.inbound_messages(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_a_date_text_is_made_once(spark):
    """Each more copy of the expression that a date is read from is computed again for every row."""
    made = spark.range(1).select(V.normalise_date(F.date_format(F.current_date(), "d / M / yy")).alias("d"))
    assert made._jdf.queryExecution().analyzed().toString().count("date_format(") == 1


def test_the_search_index_has_no_row_per_form(spark):
    """Forms are made of different words only; the index is neither that much larger nor aggregated as a whole."""
    bills = spark.createDataFrame([(1, 7, "harbour mills", "rent", "logged", T0)], "bill_id int, user_id int, vendor string, category string, status string, confirmed_at timestamp")
    index = LO.index_bills(bills)
    assert sorted(r["word"] for r in index.collect()) == ["2024-01", "harbour", "jan", "january", "mills", "rent"]
    assert "Aggregate" not in index._jdf.queryExecution().optimizedPlan().toString()


def test_posted_payments_are_never_broadcast(spark):
    """A small table of rules is many payments; the planner takes their size from the table."""
    rules = spark.createDataFrame([(1, 2, "Old Mill", 5.0, T0.date(), "weekly")], "rule_id int, user_id int, vendor string, amount double, first_day date, period string")
    due = R.due_payments(R.expand_recurring(rules, F.lit("2024-02-01")), R.expand_recurring(rules, F.lit("2024-01-10")))
    assert "Broadcast" not in due._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["payment_id"] for r in due.collect()) == ["rule/1/2024-01-15", "rule/1/2024-01-22", "rule/1/2024-01-29"]


def test_the_running_sums_join_the_ledger_once(spark, sf_dir, monkeypatch):
    """Each more run of the ledger's joins sends their small sides through the driver again."""
    seen, ledger = [], VW.ledger
    monkeypatch.setattr(TO.RunningSums, "add", lambda self, changes, batch: seen.append(changes._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(TO.RunningSums, "sums", lambda self: None)
    Q._running_sums(spark, sf_dir)
    assert len(seen) == 10 and not any("Join" in plan for plan in seen)
    assert "Join" in ledger(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_known_vendors_are_one_row_per_word(spark):
    """Names meet by whole words; only the different words are spread into their forms."""
    names = spark.createDataFrame([(1, "HARBOUR MILLS")], "user_id int, name string").withColumns({"folded": F.col("name"), "words": F.split("name", " "), "n": F.lit(2)})
    assert N._indexed(names, ["user_id"]).count() == 2
    known = spark.createDataFrame([(1, "Harbour Mills"), (1, "Old Rent"), (2, "Harbour Mill")], "user_id int, vendor string")
    asked = spark.createDataFrame([(1, "HARBOR MILLS"), (1, "HARBOUR TOOLS"), (2, "HARBOR MILLS"), (3, "HARBOR MILLS")], "user_id int, name string")
    got = {tuple(r) for r in N.resolve_vendors(asked, "name", known, scope="user_id").collect()}
    assert got == {(1, "HARBOR MILLS", "Harbour Mills"), (1, "HARBOUR TOOLS", None), (2, "HARBOR MILLS", "Harbour Mill"), (3, "HARBOR MILLS", None)}


def test_messages_are_read_once(spark, monkeypatch):
    """The first contacts and the drafts both need the readings; the rules must not run for each."""
    seen, replay = [], P.jobs.replay
    monkeypatch.setattr(P.jobs, "replay", lambda read, *a, **b: seen.append(read) or replay(read, *a, **b))
    columns = "user_phone string, wa_message_id string, wa_received_at timestamp, kind string, text string, ocr_text string, image_urls array<string>, answer string"
    answer = '{"amount": 45.5, "date": "01/01/2024", "vendor": "Shop", "gst_basis": "none", "confidence": "high"}'
    messages = spark.createDataFrame([("u", "m", T0, "photo", None, None, ["a"], answer)], columns)
    users = spark.createDataFrame([("u", 1)], "user_phone string, business_id long")
    businesses = spark.createDataFrame([(1, True, True, "Australia/Perth")], "business_id long, gst_registered boolean, auto_save boolean, timezone string")
    assert [float(r["amount"]) for r in P.ledger_from_messages(messages, users, businesses, image_answer=F.col("answer")).collect()] == [45.5]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
