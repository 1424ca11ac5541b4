"""Token buckets, sums that are kept up to date, and search of many requests, each against a plain loop."""

import random
import tempfile
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperledger.operators import limits as LM
from paperledger.operators import lookup as LO
from paperledger.operators import totals as TO
from paperledger.streaming import jobs
from tests.test_machine import SCHEMA as MESSAGES
from tests.test_machine import photo, text

START = datetime(2024, 2, 1)


# Token buckets


def arrivals(seed, users=6, n=80):
    rng, rows = random.Random(seed), []
    for user in range(users):
        at = 0
        for k in range(n):
            at += rng.choice([0, 0, 1, 3, 20, 20, 45, 70, 400, 9000])
            rows.append((f"u{user}", f"{k:03}", START + timedelta(seconds=at)))
    return rows


def walked(rows, rate, burst):
    out = {}
    for user in {r[0] for r in rows}:
        level, last = burst * 60_000, None
        for _, message, at in sorted(r for r in rows if r[0] == user):
            moment = round((at - START).total_seconds() * 1000)
            if last is not None:
                level = min(burst * 60_000, level + (moment - last) * rate)
            last = moment
            if passed := level >= 60_000:
                level -= 60_000
            out[user, message] = (passed, level // 60_000)
    return out


def found(df):
    return {(r["user_phone"], r["wa_message_id"]): (r["passed"], r["tokens"]) for r in df.collect()}


@pytest.mark.parametrize("rate,burst", [(1, 3), (30, 60), (2, 1)])
def test_buckets_equal_a_walk(spark, rate, burst):
    rows = arrivals(rate)
    df = spark.createDataFrame(rows, "user_phone string, wa_message_id string, wa_received_at timestamp").repartition(3)
    want = walked(rows, rate, burst)
    assert found(LM.throttled(df, rate, burst)) == want
    assert rate == 30 or {passed for passed, _ in want.values()} == {True, False}


def test_buckets_as_a_stream_equal_the_table(spark):
    rows = sorted(arrivals(5, users=3, n=60), key=lambda r: (r[2], r[1]))
    schema, folder = "user_phone string, wa_message_id string, wa_received_at timestamp", tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = LM.throttled_stream(stream, 1, 3).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert found(spark.read.parquet(folder + "/out")) == walked(rows, 1, 3)


# Sums

BILLS = "bill_id int, business_id long, vendor string, category string, amount decimal(18,2), gst decimal(18,2), auto_logged boolean, type string, status string, confirmed_at timestamp, sign int"


def bill(rng, k, sign=1):
    return (k, rng.choice([1, 2]), rng.choice(["a", "b", None]), rng.choice(["rent", None]), rng.choice([None, Decimal(rng.randint(1, 9999)) / 100]), rng.choice([None, Decimal("1.10")]),
            rng.choice([True, False, None]), rng.choice(["incoming", None]), rng.choice(["logged", "paid", "draft"]), START + timedelta(days=rng.randint(0, 40)), sign)


def test_sums_equal_the_sums_of_what_is_left(spark):
    rng, folder = random.Random(9), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store, held = TO.RunningSums(spark, folder, fanout=3), {}
    for batch in range(11):
        changes = []
        for k in range(12):
            old = rng.choice(list(held)) if held and rng.random() < 0.4 else None
            if old is not None:
                changes.append((*held.pop(old)[:-1], -1))
            else:
                held[batch, k] = bill(rng, batch * 100 + k)
                changes.append(held[batch, k])
        df = spark.createDataFrame(changes, BILLS)
        store.add(df, batch)
        if batch in (2, 8):
            store.add(df, batch)  # the batch is repeated, as after a failure
    left = spark.createDataFrame(list(held.values()), BILLS)
    rows = lambda df: sorted(map(tuple, df.select(*TO.KEYS, *TO.SUMS).collect()), key=repr)
    assert rows(store.sums()) == rows(TO.merged(TO.sums_of(left)))
    counted = [b for b in held.values() if b[8] != "draft"]
    total = TO.totals(store.sums()).head()
    assert (total["bills"], total["auto_logged"]) == (len(counted), sum(bool(b[6]) for b in counted))
    assert total["amount"] == pytest.approx(float(sum(b[4] or 0 for b in counted)))
    assert {r["value"] for r in TO.options(store.sums()).filter("kind = 'vendor'").collect()} == {b[2] for b in counted if b[2]}
    assert len(store._live(store._sets())) == 3  # nine batches as one set, and two more


def test_steps_of_the_machine_become_changes(spark):
    rows = [photo("u", "m1", 0, 10.0), text("u", "m2", 1, "delete"), photo("u", "m3", 2, 20.0), photo("v", "m4", 0, 30.0, auto=False), text("v", "m5", 1, "1")]
    steps = jobs.replay(spark.createDataFrame(rows, MESSAGES))
    changes = TO.changes_of_steps(steps)
    assert sorted((r["draft_id"], r["sign"], float(r["amount"])) for r in changes.collect()) == [("m1/0", -1, 10.0), ("m1/0", 1, 10.0), ("m3/0", 1, 20.0), ("m4/0", 1, 30.0)]
    ready = changes.withColumns({"business_id": F.lit(1).cast("long"), "category": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    assert TO.totals(TO.sums_of(ready)).head()["amount"] == 50.0


# Search


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    rows = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return rows[-1][-1]


def test_search_equals_a_scan(spark):
    rng, words = random.Random(3), ["harbour", "mills", "mill", "rent", "tools", "march", "tool"]
    bills = [(k, rng.randint(1, 4), " ".join(rng.sample(words, rng.randint(1, 2))) if k % 9 else None, rng.choice(["rent", "wages", None]), rng.choice(["logged", "paid", "draft"]), START + timedelta(days=rng.randint(0, 90))) for k in range(150)]
    table = spark.createDataFrame(bills, "bill_id int, user_id int, vendor string, category string, status string, confirmed_at timestamp")
    asks = ["harbour", "harbor", "find mill", "MILLS rent", "2024-03", "february", "feb wages", "tolos", "rents", "find", "", None, "misc", "tools harbour march", "zzz"]
    requests = [(u * 100 + k, u, a) for u in range(1, 6) for k, a in enumerate(asks)]
    got = {}
    for r in LO.search_requests(spark.createDataFrame(requests, "request_id int, user_id int, text string"), LO.index_bills(table)).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["bill_id"])
    want = {}
    for request, user, ask in requests:
        asked = (ask or "").lower().split()
        asked = asked[1:] if asked[:1] in (["find"], ["show"]) else asked
        hits = []
        for b in bills:
            vendor = (b[2] or "").split()
            exact = {b[3] or "misc", b[5].strftime("%B").lower(), b[5].strftime("%b").lower(), b[5].strftime("%Y-%m"), *vendor}
            fits = [w in exact or any(len(w) >= 4 and len(v) >= 4 and edits(w, v) <= 1 for v in vendor) for w in asked]
            if asked and all(fits) and b[1] == user and b[4] != "draft":
                hits.append((b[5], b[0]))
        if hits:
            want[request] = [k for _, k in sorted(hits, reverse=True)[:5]]
    assert got == want and len(want) > 20


def test_requests_find_amounts_parts_and_month_numbers(spark):
    rows = [(1, "City Water", "utilities", "90.00", 8), (2, "Smith-Jones Pty", "Office Supplies", "1250.50", 7), (3, "Harbour Gas", "rent", "1250.50", 8), (4, "J&B 7-Eleven 90", None, None, 12), (5, None, "rent", "0.00", 2)]
    made = [(i, 1, v, c, "logged", datetime(2025, m, 3), a and Decimal(a)) for i, v, c, a, m in rows]
    index = LO.index_bills(spark.createDataFrame(made, "bill_id int, user_id int, vendor string, category string, status string, confirmed_at timestamp, amount decimal(18,2)"))
    wanted = {
        "$1,250.50": {2, 3}, "1250.5": {2, 3}, "find $1250.50 gas": {3}, "1,250": set(), "1250.501": set(), "90": {1, 4}, "$90.00": {1}, "0": {4, 5}, "rent, 1250.50": {3},
        "wat": {1}, "harb": {3}, "rbou": {3}, "mith-jone": {2}, "smith-jones": {2}, "smith": {2}, "7-eleven": {4}, "j&b": {4}, "j b": {4}, "arbour as": {3},
        "8": {1, 3}, "12": {4}, "2025-08": {1, 3}, "2025-0": set(), "office": {2}, "supplies office": {2}, "utilit": set(), "3,4": set(),
    }
    asks = list(wanted)
    found = LO.search_requests(spark.createDataFrame(list(enumerate(asks)), "request_id int, text string").withColumn("user_id", F.lit(1)), index).collect()
    assert {a: {r["bill_id"] for r in found if asks[r["request_id"]] == a} for a in asks} == wanted
    assert sorted(r["rank"] for r in found if asks[r["request_id"]] == "8") == [1, 2]
