"""Known users, settings over time, the set-up, readings by image, and the state that a message touches."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperledger.operators import ledger as L
from paperledger.operators import pipeline as P
from paperledger.streaming import jobs
from paperledger.streaming.drafts import Conversation, History

START = datetime(2024, 5, 6, 8, 0, 0)
SCHEMA = (
    "user_phone string, wa_message_id string, wa_received_at timestamp, kind string, text string, images int, image int, auto_ok boolean, "
    "auto_save boolean, gst_registered boolean, amount double, amount_conf double, date string, date_conf double, vendor string, gst_basis string"
)


def at(minute):
    return START + timedelta(minutes=minute)


def photo(user, message, minute, amount=110.0, auto=True, image=None, images=1, vendor="Shop"):
    return (user, message, at(minute), "photo", None, images, image, auto, None, None, amount, 1.0, "2024-05-01", 1.0, vendor, "inclusive")


def text(user, message, minute, words):
    return (user, message, at(minute), "text", words, None, None, None, None, None, None, None, None, None, None, None)


def setting(user, message, minute, auto=None, gst=None):
    return (user, message, at(minute), "setting", None, None, None, None, auto, gst, None, None, None, None, None, None)


def events(out, user):
    minute = (F.unix_seconds("at") - F.unix_seconds(F.lit(START))) / 60
    return [(r[0], r[1]) for r in out.filter(F.col("user_phone") == user).orderBy("at", "draft_id").select(minute, "event").collect()]


ROWS = [
    text("known", "k1", 0, "delete"),
    photo("known", "k2", 1),
    text("known", "k3", 2, "delete"),
    text("new", "n1", 0, "delete"),
    photo("off", "o1", 0, 10.0),
    text("off", "o2", 1, "autosave off"),
    photo("off", "o3", 2, 20.0),
    text("off", "o4", 3, "1"),
    text("off", "o5", 4, "autosave on"),
    photo("off", "o6", 5, 30.0),
    setting("ruled", "s1", 1, auto=False, gst=False),
    photo("ruled", "r1", 0, 10.0),
    photo("ruled", "r2", 2, 20.0),
    text("ruled", "r3", 3, "4"),
    setting("ruled", "s2", 4, auto=True),
    photo("ruled", "r4", 4, 30.0),  # behind the change of the same moment
    photo("wizard", "w1", 0, 10.0, auto=False),
    text("wizard", "w2", 1, "setup"),
    text("wizard", "w3", 2, "1"),  # the name, not an answer to the draft
    text("wizard", "w4", 3, "nowhere"),
    text("wizard", "w5", 4, " Perth "),
    text("wizard", "w6", 5, "no"),
    text("wizard", "w7", 6, "1"),
    text("half", "h1", 0, "skip"),
    text("half", "h2", 1, "yes"),
    *[photo("many", "m1", 0, 10.0 + i, image=i, images=3, vendor=f"Shop {i}") for i in range(3)],
    *[photo("many", "m1", 1, 10.0 + i, image=i, images=3, vendor=f"Shop {i}") for i in range(3)],  # sent again
    text("many", "m2", 2, "next"),
    text("many", "m3", 3, "1"),
    text("many", "m4", 4, "next"),
    text("many", "m5", 5, "1"),
    setting("stranger", "s3", 0, auto=False),
    photo("stranger", "t1", 3),
]
USERS = [("known", None), ("half", "timezone"), ("off", "done"), ("silent", "name")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(USERS, "user_phone string, setup_step string")


@pytest.fixture(scope="module")
def steps(tables):
    return jobs.replay(tables[0], users=tables[1]).cache()


def test_a_known_user_has_no_first_contact(steps):
    assert events(steps, "known") == [(0, "undo_nothing"), (1, "auto_logged"), (2, "undone")]
    assert events(steps, "new") == [(0, "onboarded")]


def test_autosave_acts_on_later_photos(steps):
    assert [e for _, e in events(steps, "off")] == ["auto_logged", "autosave off", "awaiting_confirm", "confirmed", "autosave on", "auto_logged"]


def test_settings_from_elsewhere_act_from_their_moment(steps):
    assert [e for _, e in events(steps, "ruled")] == ["onboarded", "auto_logged", "awaiting_confirm", "skipped", "auto_logged"]
    gst = {r["draft_id"]: r["gst"] for r in steps.filter("user_phone = 'ruled' and draft_id is not null").collect()}
    assert gst == {"r1/0": 0.91, "r2/0": None, "r4/0": None}
    assert events(steps, "stranger") == [(3, "onboarded"), (3, "awaiting_confirm"), (9, "nudged"), (13, "expired")]


def test_set_up_answers_go_before_the_draft(steps):
    found = steps.filter("user_phone = 'wizard'").orderBy("at", "event").select("event", "setting", "setting_value").collect()
    assert [tuple(r) for r in found if r["event"] not in ("nudged", "onboarded", "awaiting_confirm")] == [
        ("setup", None, None), ("setup_answer", "business_name", "1"), ("setup_refused", "timezone", None),
        ("setup_answer", "timezone", "Australia/Perth"), ("setup_done", "gst_registered", "false"), ("confirmed", None, None),
    ]
    assert [e for _, e in events(steps, "half")] == ["setup_answer", "setup_done"]


def test_each_image_has_its_own_reading(steps):
    logged = steps.filter("user_phone = 'many' and event in ('auto_logged', 'confirmed')").orderBy("at").select("draft_id", "amount", "vendor").collect()
    assert [tuple(r) for r in logged] == [("m1/0", 10.0, "Shop 0"), ("m1/1", 11.0, "Shop 1"), ("m1/2", 12.0, "Shop 2")]
    assert [e for _, e in events(steps, "many")].count("retry") == 1


def _rows(df):
    return sorted(tuple(r) for r in df.select([F.col(c).cast("string") for c in df.columns]).na.fill("-").collect())


def streamed(spark, rows, users, files=3):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = sorted(rows, key=lambda r: r[2])
    last = photo("zz", "zz", 60 * 24 * 4000)
    size = -(-len(rows) // files)
    for k in [*range(0, len(rows), size), None]:
        part = [last] if k is None else rows[k : k + size]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = (
        jobs.draft_stream(stream, users=users).writeStream.format("parquet").option("path", folder + "/out")
        .option("checkpointLocation", folder + "/state").outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return spark.read.parquet(folder + "/out").filter("user_phone <> 'zz'")


def test_the_stream_equals_the_replay(spark, tables, steps):
    assert _rows(streamed(spark, ROWS, tables[1])) == _rows(steps)


def test_long_histories_are_the_same_in_the_stream(spark):
    rng, rows = random.Random(2), []
    for k in range(260):
        day = rng.randint(0, 200) * 1440 + rng.randint(0, 1400)
        rows.append(photo("busy", f"b{k:03}", day, rng.choice([10.0, 20.0, 30.0, 40.0, 50.0, 60.0]), vendor=rng.choice(["Shop", "Mill"])))
        if rng.random() < 0.3:
            rows.append(text("busy", f"c{k:03}", day + 2, rng.choice(["1", "delete", "2", "12.50"])))
            if rng.random() < 0.4:
                rows.append(text("busy", f"d{k:03}", day + 30, "delete"))
    batch = jobs.replay(spark.createDataFrame(rows, SCHEMA))
    seen = {r["event"] for r in batch.collect()}
    assert {"auto_logged", "awaiting_confirm", "undone", "confirmed"} <= seen and batch.filter("duplicate_of is not null").count() > 20
    assert _rows(streamed(spark, rows, None, files=5)) == _rows(batch)


def test_a_message_reads_at_most_two_keys():
    asked = []

    class Counting(History):
        def newest(self, key, since):
            asked.append(key)
            return super().newest(key, since)

    talk = Conversation("u", history=Counting())
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for k in range(300):
        m = dict(zip(names, photo("u", f"m{k}", k * 30, 10.0 + k % 40)))
        asked.clear()
        talk.handle({**m, "message": m["wa_message_id"], "at": k * 30 * 60_000, "invoice_number": f"i{k}"}, k == 0)
        assert len(asked) <= 2


def test_settings_as_of_equals_a_look_back(spark):
    rng = random.Random(4)
    changes = [(rng.choice([1, 1, 1, 2, 3, None]), at(rng.randint(0, 9000)), k, rng.choice([True, False, None]), rng.choice(["a", "b", None])) for k in range(60)]
    asked = [(rng.choice([1, 1, 2, 3, 4, None]), at(rng.randint(-500, 9500)), k, True) for k in range(300)]
    asked += [(c[0], c[1], 1000 + k, True) for k, c in enumerate(changes[:10])]
    messages = spark.createDataFrame(asked, "business_id int, wa_received_at timestamp, n int, auto_save boolean")
    table = spark.createDataFrame(changes, "business_id int, ts timestamp, change_id int, auto_save boolean, zone string")
    for hours in (1, 24):
        got = {r["n"]: r for r in L.settings_as_of(messages, table, "business_id", ["auto_save", "zone"], bucket_hours=hours).collect()}
        assert len(got) == len(asked)
        for key, moment, n, given in asked:
            for k, field in ((3, "auto_save"), (4, "zone")):
                met = max(((c[1], c[2], c[k]) for c in changes if key is not None and c[0] == key and c[k] is not None and c[1] <= moment), default=None)
                assert got[n][field] == (met[2] if met else given if field == "auto_save" else None)
                assert got[n][f"{field}_at"] == (met[0] if met else None)


def test_setting_rows_reach_every_user_of_a_business(spark):
    users = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "user_phone string, business_id int")
    changes = spark.createDataFrame([(1, at(0), 7, False, None)], "business_id int, ts timestamp, change_id int, auto_save boolean, gst_registered boolean")
    like = spark.createDataFrame([], SCHEMA)
    rows = P.setting_rows(changes, users, like)
    assert rows.columns == like.columns
    assert sorted((r["user_phone"], r["kind"], r["auto_save"]) for r in rows.collect()) == [("a", "setting", False), ("b", "setting", False)]


def test_the_stream_counts_what_happens_and_what_comes_late(spark):
    from paperledger.streaming import sinks

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parts = [
        [photo("a", "a1", 0, auto=False), photo("b", "b1", 0, 20.0)],
        [text("b", "b2", 100, "delete")],  # the draft of a is reminded and expires
        [photo("c", "c1", 200, 30.0)],
        [text("c", "c2", 20, "help"), text("c", "c3", 201, "delete")],  # one of them is far behind
        [photo("zz", "zz", 9000)],
    ]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    steps = sinks.counted(jobs.draft_stream(stream))
    query = steps.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    total = sinks.counters(query).agg(*[F.sum(c).alias(c) for c in ("nudged", "expired", "auto_logged", "undone", "steps", "late")]).head()
    out = spark.read.parquet(folder + "/out")
    events = [r["event"] for r in out.collect()]
    assert {c: total[c] for c in ("nudged", "expired", "auto_logged", "undone")} == {c: events.count(c) for c in ("nudged", "expired", "auto_logged", "undone")}
    assert (total["nudged"], total["expired"], total["undone"], total["steps"], total["late"]) == (1, 1, 2, len(events), 1)
    assert out.filter("event = 'help'").count() == 0
