"""The draft life cycle: literal conversations, and stream against batch replay."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperledger.plans import queries as Q
from paperledger.streaming import jobs

START = datetime(2024, 3, 1, 9, 0, 0)
SCHEMA = (
    "user_phone string, wa_message_id string, wa_received_at timestamp, kind string, text string, images int, "
    "auto_ok boolean, amount double, amount_conf double, date string, date_conf double, vendor string, gst_basis string"
)


def photo(user, message, minute, auto=False, images=1):
    at = START + timedelta(minutes=minute)
    return (user, message, at, "photo", None, images, auto, 110.0, 1.0, "2024-02-28", 1.0, "Shop", "inclusive")


def text(user, message, minute, words):
    at = START + timedelta(minutes=minute)
    return (user, message, at, "text", words, None, None, None, None, None, None, None, None)


def run(spark, rows):
    out = jobs.replay(spark.createDataFrame(rows, SCHEMA))
    minute = (F.unix_seconds("at") - F.unix_seconds(F.lit(START))) / 60
    got = out.orderBy("user_phone", "at", "event").select("user_phone", minute.alias("m"), "event", "draft_id", "gate", "amount", "gst", "vendor").collect()
    events = {}
    for r in got:
        events.setdefault(r["user_phone"], []).append((r["m"], r["event"]))
    return events, got


def test_conversations(spark):
    rows = [
        text("a", "a0", -5, "hi"),
        photo("a", "a1", 0),
        photo("a", "a1", 1),  # retry while the draft is open
        text("a", "a2", 2, "1"),
        photo("a", "a1", 3),  # the key is free again once logged
        text("a", "a3", 4, "4"),
        text("a", "a4", 5, "delete"),
        text("a", "a5", 6, "delete"),
        photo("b", "b1", 0),  # first contact by photo goes on
        text("b", "b2", 1, "2"),
        text("b", "b3", 2, "abc"),
        text("b", "b4", 3, "4"),  # taken as the amount
        text("b", "b5", 4, "3"),
        text("b", "b6", 5, " New Name "),
        photo("c", "c1", 0, auto=True),
        text("c", "c2", 60 * 23, "delete"),
        photo("d", "d1", 0),
        text("d", "d2", 1, "1"),
        text("d", "d3", 7, "delete"),  # confirmed by hand: five minutes only
        text("d", "d4", 60 * 30, "delete"),
        photo("e", "e1", 0, images=3),
        text("e", "e2", 1, "1"),
        text("e", "e3", 2, "next"),
        text("e", "e4", 3, "help"),
        photo("f", "f1", 0, images=2),
        text("f", "f2", 1, "1"),
        text("f", "f3", 7, "next"),
    ]
    events, got = run(spark, rows)
    assert events["a"] == [
        (-5, "onboarded"), (0, "awaiting_confirm"), (1, "retry"), (2, "confirmed"), (3, "awaiting_confirm"),
        (4, "skipped"), (5, "undone"), (6, "undo_nothing"),
    ]
    # Gone past its time of reminder while queued: reminded when it becomes active.
    assert [(m, e) for m, e in events["f"] if e in ("promoted", "nudged", "expired")] == [(7, "nudged"), (7, "promoted"), (10, "expired")]
    assert events["b"] == [
        (0, "awaiting_confirm"), (0, "onboarded"), (1, "editing"), (2, "edit_refused"), (3, "edited"), (4, "editing"),
        (5, "edited"), (6, "nudged"), (10, "expired"),
    ]
    assert events["c"] == [(0, "auto_logged"), (0, "onboarded"), (1380, "undone")]
    assert events["d"] == [(0, "awaiting_confirm"), (0, "onboarded"), (1, "confirmed"), (7, "undo_too_late"), (1800, "undo_nothing")]
    assert [e for _, e in events["e"]] == [
        "awaiting_confirm", "onboarded", "queued", "queued", "confirmed", "promoted", "help", "nudged", "expired", "expired",
    ]
    edited = [r for r in got if r["user_phone"] == "b" and r["event"] == "edited"]
    assert (edited[0]["amount"], edited[0]["gst"], edited[0]["gate"]) == (4.0, 0.36, "high")
    assert edited[1]["vendor"] == "New Name"


def test_a_copy_of_a_logged_bill_is_not_logged_by_itself(spark):
    rows = [
        photo("a", "a1", 0, auto=True),
        photo("a", "a1", 3, auto=True),  # sent again after it was logged
        photo("a", "a2", 60, auto=True),  # another photo of the same bill
        text("a", "a3", 61, "4"),
        text("a", "a4", 62, "delete"),
        photo("a", "a5", 70, auto=True),  # undone, so no copy any more
        photo("b", "b1", 0, auto=True),
        photo("b", "b2", 60 * 24 * 90, auto=True),
        photo("b", "b3", 60 * 24 * 90 + 20, auto=True),  # beyond 90 days of the first
    ]
    out = jobs.replay(spark.createDataFrame(rows, SCHEMA))
    minute = (F.unix_seconds("at") - F.unix_seconds(F.lit(START))) / 60
    got = {}
    for r in out.filter("event in ('auto_logged', 'awaiting_confirm', 'undone')").orderBy("at").select("user_phone", minute.alias("m"), "event", "duplicate_of").collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    assert got["a"] == [(0, "auto_logged", None), (3, "awaiting_confirm", "a1/0"), (60, "awaiting_confirm", "a1/0"), (62, "undone", None), (70, "auto_logged", None)]
    day = 60 * 24 * 90
    assert got["b"] == [(0, "auto_logged", None), (day, "awaiting_confirm", "b1/0"), (day + 20, "auto_logged", None)]
    from paperledger.operators.pipeline import fold_steps

    ledger = sorted((r["user_phone"], r["draft_id"], r["status"]) for r in fold_steps(out).collect())
    assert ledger == [("a", "a1/0", "deleted"), ("a", "a5/0", "logged"), ("b", "b1/0", "logged"), ("b", "b3/0", "logged")]


def test_an_unregistered_business_pays_no_gst(spark):
    rows = spark.createDataFrame([photo("a", "a1", 0), photo("b", "b1", 0)], SCHEMA)
    out = jobs.replay(rows.withColumn("gst_registered", F.col("user_phone") == "a")).filter("event = 'awaiting_confirm'")
    assert {r["user_phone"]: r["gst"] for r in out.collect()} == {"a": 10.0, "b": None}


def _rows(df):
    return sorted(tuple(r) for r in df.select([F.col(c).cast("string") for c in df.columns]).na.fill("-").collect())


def test_chunks_do_not_change_the_replay(spark, sf_dir):
    messages = Q._inbound(spark, sf_dir)
    # Spread over days so that many chunk borders fall inside conversations.
    small, large = jobs.replay(messages, chunk_hours=1), jobs.replay(messages, chunk_hours=24 * 365 * 100)
    assert _rows(small) == _rows(large)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_replay(spark, sf_dir, files):
    # A last message far in the future moves the watermark past every timer.
    messages = Q._inbound(spark, sf_dir).drop("machine_read")
    last = messages.limit(1).withColumns(
        {"user_phone": F.lit("zz"), "wa_message_id": F.lit("zz"), "wa_received_at": F.lit("2031-01-01").cast("timestamp")}
    )
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    everything = messages.unionByName(last).withColumn("part", F.ntile(files).over(Window.orderBy("wa_received_at")))
    everything.write.parquet(folder + "/all")
    for i in range(1, files + 1):  # one after the other, so that the stream meets them in time order
        part = spark.read.parquet(folder + "/all").filter(F.col("part") == i).drop("part")
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
    schema = spark.read.parquet(folder + "/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = (
        jobs.draft_stream(stream)
        .writeStream.format("parquet")
        .option("path", folder + "/out")
        .option("checkpointLocation", folder + "/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(100)
    got = spark.read.parquet(folder + "/out").filter("user_phone <> 'zz'")
    want = jobs.replay(messages)
    assert got.count() > 300
    # Resends are in the data: while a draft is open they are retries, later they count anew.
    again = messages.groupBy("user_phone", "wa_message_id").count().filter("count > 1")
    assert again.count() > 5 and want.filter("event = 'retry'").count() > 0
    assert _rows(got) == _rows(want)


def test_message_source_as_stream(spark, sf_dir):
    from paperledger.plans import views
    from paperledger.sources import readers

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    views.messages(spark, sf_dir).select("raw").write.mode("overwrite").text(folder + "/in")
    query = (
        readers.read_message_stream(spark, folder + "/in")
        .writeStream.format("parquet")
        .option("path", folder + "/out")
        .option("checkpointLocation", folder + "/state")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(60)
    usable = views.table(spark, sf_dir, "events").filter("event_type in ('purchase', 'click', 'view')").count()
    assert spark.read.parquet(folder + "/out").count() == usable


def test_rates_as_stream_equal_the_table(spark, sf_dir):
    from paperledger.plans import views

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_phone"), F.col("ts").alias("wa_received_at"))
    # A last message moves the watermark past every minute.
    late = events.limit(1).withColumns({"user_phone": F.lit("zz"), "wa_received_at": F.lit("2031-01-01").cast(events.schema["wa_received_at"].dataType)})
    events.coalesce(1).write.parquet(folder + "/in")
    late.coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = (
        jobs.rate_per_minute(stream, 1, 2)
        .writeStream.format("parquet")
        .option("path", folder + "/out")
        .option("checkpointLocation", folder + "/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(100)
    assert _rows(spark.read.parquet(folder + "/out")) == _rows(jobs.rate_per_minute(events, 1, 2))


def _pieces(spark, rows, schema, folder):
    """The rows as a stream of one file each."""
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_onboarding_and_settings_as_streams(spark):
    from paperledger.operators import ledger as L
    from paperledger.streaming import sinks

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("a", START), ("b", START + timedelta(minutes=1)), ("a", START + timedelta(minutes=2))]
    stream = _pieces(spark, rows, "user_phone string, wa_received_at timestamp", folder)
    writer = sinks.onboard_stream(stream, folder + "/users", folder + "/state")
    assert writer.trigger(availableNow=True).start().awaitTermination(60)
    users = spark.read.parquet(folder + "/users").drop("batch")
    whole = L.onboard(spark.read.parquet(folder + "/in"), spark.createDataFrame([], "user_phone string"))
    assert _rows(users) == _rows(whole.select(*users.columns)) and users.count() == 2

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("a", START, 1, True, None), ("a", START + timedelta(minutes=1), 2, None, "Perth"), ("a", START + timedelta(minutes=2), 3, False, None)]
    schema = "user_phone string, ts timestamp, change_id int, auto_save boolean, timezone string"
    changes = _pieces(spark, rows, schema, folder)
    assert sinks.settings_stream(changes, folder + "/s", folder + "/state").trigger(availableNow=True).start().awaitTermination(60)
    latest = L.latest_settings(sinks.read_grown(spark, folder + "/s", changes.schema), "user_phone", "ts", ["auto_save", "timezone"])
    assert [tuple(r) for r in latest.collect()] == [("a", False, "Perth")]
