"""Jobs against brute force on small fixtures, and literal report cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperledger.functions.values import FOLD_FROM, FOLD_TO
from paperledger.operators import analytics as A
from paperledger.operators import duplicates as D
from paperledger.operators import evaluate as E
from paperledger.operators import ledger as L
from paperledger.operators.vendors import merge_known_vendors, resolve_vendors
from paperledger.sources import readers, writers

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("bucket", ["minute", "hour", "year"])
def test_duplicates_against_brute_force(spark, bucket):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        # One user, one vendor and one amount hold a large share of the rows.
        user = "u1" if rng.random() < 0.4 else f"u{rng.randrange(5)}"
        rows.append(
            (
                i,
                user,
                rng.choice(["Shop", "Shop", "Other", None]),
                rng.choice([100, 100, 250, None]),
                rng.choice([None, None, "I1", "I2"]),
                rng.choice(["logged", "paid", "draft", "deleted"]),
                T0 + timedelta(days=rng.randrange(900), minutes=rng.randrange(3)),
            )
        )
    names = "bill_id int, user_id string, vendor string, amount int, invoice_number string, status string, confirmed_at timestamp"
    df = spark.createDataFrame(rows, names)
    got = {r["bill_id"]: (r["duplicate_of"], r["matched_on"]) for r in D.find_duplicates(df, bucket=bucket).collect()}
    assert len(got) == len(rows)
    for c in rows:
        best = (None, None)
        for kind in ("vendor_amount", "invoice"):
            found = [
                (p[6], p[0])
                for p in rows
                if p[1] == c[1]
                and p[5] in ("logged", "paid")
                and (p[6], p[0]) < (c[6], c[0])
                and p[6] >= c[6] - timedelta(days=90)
                and (
                    (kind == "invoice" and c[4] is not None and p[4] == c[4])
                    or (kind == "vendor_amount" and None not in (c[2], c[3]) and p[2:4] == c[2:4])
                )
            ]
            if found:
                best = (max(found)[1], kind)
        assert got[c[0]] == best, c


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _shapes(name):
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in name.upper())
    plain = " ".join(kept.split())
    return plain, plain.translate(str.maketrans(FOLD_FROM, FOLD_TO)).split(" ")


def test_vendor_matching_against_brute_force(spark):
    rng = random.Random(3)
    firsts, seconds = ["THE", "THE", "THE", "OLD", "COLD", "BOLD"], ["MILL", "MILE", "BAKER", "BAKERY", "SHOP", "5HOP"]
    known = sorted({f"{rng.choice(firsts)} {rng.choice(seconds)}" for _ in range(40)} | {"Telstra", "A", "AB", "The Mill-House"})

    def mangle(name):
        i = rng.randrange(len(name) + 1)
        return rng.choice([name[:i] + name[i + 1 :], name[:i] + "X" + name[i:], name[:i] + "l" + name[i + 1 :], name, name.lower()])

    asked = sorted({mangle(mangle(rng.choice(known))) for _ in range(250)} | {"", "%%", "Te1stra"})
    rows = [(i, a) for i, a in enumerate(asked)] + [(9999, None), (9998, asked[5])]
    out = resolve_vendors(spark.createDataFrame(rows, "i int, name string"), "name", spark.createDataFrame([(k,) for k in known], "vendor string"))
    got = {r["i"]: r["resolved_to"] for r in out.collect()}
    assert len(got) == len(rows)
    hits = 0
    for i, name in rows:
        expected = None
        if name is not None and _shapes(name)[0] != "":
            plain, words = _shapes(name)
            scored = []
            for k in known:
                k_plain, k_words = _shapes(k)
                if k_plain == plain or len(k_words) != len(words):
                    continue
                steps = [_distance(a, b) for a, b in zip(words, k_words)]
                if max(steps) <= 1:
                    scored.append((sum(steps), k))
            best = [k for s, k in scored if s == min(scored)[0]]
            expected = best[0] if len(best) == 1 else None
        assert got[i] == expected, name
        hits += expected is not None
    assert hits > 30


def test_known_vendor_merge(spark):
    learned = ["caltex", "mora and cousins roofing", "", None, "CALTEX", "%% !!", "q", "Mora & Cousins roofing", "MORA AND COUSINS ROOFING"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(learned)], "vendor string, rank int")
    merged = {r["vendor"] for r in merge_known_vendors(df).collect()}
    assert {"Caltex", "mora and cousins roofing", "Mora & Cousins roofing", "HDFC Bank"} <= merged
    assert len(merged) == 11


def test_seed_names_belong_to_users_without_history(spark):
    learned = spark.createDataFrame([("a", "Mora Roofing", 1), ("a", "CALTEX", 2), ("b", "Nora Tiling", 1)], "user_id string, vendor string, rank int")
    known = merge_known_vendors(learned, "user_id")
    rows = [("new", "Ca1tex"), ("a", "Ca1tex"), ("a", "Mora Roofinq"), ("b", "Mora Roofinq"), ("b", "caltex"), (None, "Ca1tex"), ("a", None)]
    out = resolve_vendors(spark.createDataFrame(rows, "user_id string, name string"), "name", known, scope="user_id")
    got = {(r["user_id"], r["name"]): r["resolved_to"] for r in out.collect()}
    assert got[("new", "Ca1tex")] == got[("a", "Ca1tex")] == "Caltex" and got[("a", "Mora Roofinq")] == "Mora Roofing"
    assert got[("b", "Mora Roofinq")] is None and got[("b", "caltex")] is None and len(got) == len(rows)


def test_learnable_trims_all_white_space(spark):
    from paperledger.functions.vendors import learnable

    df = spark.createDataFrame([("\t ab \n",), ("\t abc \n",), (" " * 70 + "Shop" + "\t" * 70,)], "v string")
    assert [r[0] for r in df.select(learnable(F.col("v"))).collect()] == [False, True, True]


def test_long_literal_lists_and_repeated_names(spark):
    from paperledger.functions.vendors import match_literal

    names = [f"Shop{chr(65 + i // 26)}{chr(65 + i % 26)}Street" for i in range(0, 600, 7)] + ["Mora Roofing", "Mora Roofing"]
    got = spark.createDataFrame([("Mora Roofinq",)], "v string").select(match_literal(F.col("v"), names)).head()[0]
    assert got == "Mora Roofing"


def test_bills_without_a_user_match_nothing(spark):
    rows = [(1, None, "Shop", 10, "I1"), (2, None, "Shop", 10, "I1"), (3, "u", "Shop", 10, "I1"), (4, "u", "Shop", 10, None)]
    df = spark.createDataFrame(rows, "bill_id int, user_id string, vendor string, amount int, invoice_number string")
    df = df.withColumns({"status": F.lit("logged"), "confirmed_at": F.timestamp_seconds(F.col("bill_id") * 60)})
    assert {r["bill_id"]: r["duplicate_of"] for r in D.find_duplicates(df).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_large_amounts_are_rounded(spark):
    from paperledger.functions.values import round2

    values = [12345678901234.567, -12345678901234.567, 2.675, 1e17, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(round2(F.col("v"))).collect()]
    assert got[:2] == [12345678901234.57, -12345678901234.57] and got[3:] == [1e17, None]


def test_whole_history_is_the_default(spark):
    rows = [(i, "u", f"v{i % 3}", "logged", T0 + timedelta(days=i)) for i in range(250)]
    bills = spark.createDataFrame(rows, "bill_id int, user_id string, vendor string, status string, confirmed_at timestamp")
    from paperledger.operators.vendors import newest_logged_vendors

    assert A.newest_per_user(bills).count() == 250 and A.newest_per_user(bills, 4).count() == 4
    assert sorted((r["vendor"], r["rank"]) for r in newest_logged_vendors(bills).collect()) == [("v0", 1), ("v1", 3), ("v2", 2)]
    assert newest_logged_vendors(bills, n=2).count() == 2


def _six_bills(spark):
    rows = [
        (1, "wages", "marta", 640, None, 6),
        (2, "rent", "old mill", 1850, None, 5),
        (3, "utilities", "city water", 90, 9, 4),
        (4, "utilities", "harbour gas", 270, 27, 3),
        (5, "inventory", "papermill", 125, 12.5, 2),
        (6, "inventory", "stone yard", 205, 20.5, 1),
    ]
    made = [(i, "u", c, v, float(a), g if g is None else float(g), "logged", False, datetime(2026, 8, 20, 12) - timedelta(days=d)) for i, c, v, a, g, d in rows]
    names = "bill_id int, user_id string, category string, vendor string, amount double, gst double, status string, auto_logged boolean, confirmed_at timestamp"
    df = spark.createDataFrame(made, names)
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("amount", "gst")})


def test_six_bill_dashboard(spark):
    bills = _six_bills(spark)
    assert tuple(A.totals(bills).head()) == (6, 3180.0, 69.0, 0, 6)
    assert [(r[0], r[2]) for r in A.by_category(bills).collect()] == [("rent", 1850.0), ("wages", 640.0), ("utilities", 360.0), ("inventory", 330.0)]
    days = A.last_days(bills, F.lit(datetime(2026, 8, 20))).collect()
    assert [r["bills"] for r in days] == [1, 1, 1, 1, 1, 1, 0]
    assert A.month_days(bills, "2026-02").count() == 28
    assert A.scope(bills, "2026-08", "utilities", "harbour gas").count() == 1
    # An unknown vendor is ignored; so is a vendor of another category.
    assert A.scope(bills, None, "utilities", "stone yard").count() == 2
    assert A.scope(bills, "1999-01", "nope", "nope").count() == 6
    assert A.newest_per_user(bills, 2).count() == 2


def test_extract_bytes(spark, tmp_path):
    bills = _six_bills(spark).filter("bill_id in (3)").select(
        "bill_id", "confirmed_at", F.lit(None).cast("string").alias("date"), F.lit(' Bob "B", Ltd').alias("vendor"),
        F.lit(" kept ").alias("vendor_resolved_to"), "category", "amount", "gst", F.lit("exclusive").alias("gst_basis"),
        F.lit(None).cast("string").alias("invoice_number"), F.lit(None).cast("string").alias("abn"), "auto_logged", F.lit("partial").alias("gate_level"),
    )
    writers.write_extract(bills.coalesce(1), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*.csv"))
    assert data.decode("utf-8") == (
        "\ufeffLogged,Bill date,Vendor,Vendor resolved to,Category,Amount,GST,GST basis,Invoice,ABN,Source,Gate\r\n"
        '2026-08-16,," Bob ""B"", Ltd", kept ,utilities,90.00,9.00,exclusive,,,manual,partial\r\n'
    )
    assert writers.csv_lines(bills).head()[0] == '2026-08-16,," Bob ""B"", Ltd", kept ,utilities,90.00,9.00,exclusive,,,manual,partial'
    name = writers.extract_name(F.lit("2026-08"), F.lit("Utilities"), F.lit("Bob's  & Co"))
    assert spark.range(1).select(name).head()[0] == "bills-2026-08-utilities-bob-s-co.csv"


def test_labels_and_files(spark, tmp_path):
    good = '{\n "id": "s1", "kind": "text", "text": "rent 50", "should_log": true, "expected": {"amount": 50.0}}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text('{"id": "", "should_log": true}')
    (tmp_path / "c.json").write_text('{"id": "s3", "should_log": false, "orientation": "sideways"}')
    (tmp_path / "d.json").write_text('{"id": "s4", "kind": "photo", "should_log": false, "hard": true}')
    ok, bad = readers.read_labels(spark, str(tmp_path))
    assert [(r["id"], r["kind"], r["hard"]) for r in ok.collect()] == [("s1", "text", False), ("s4", "image", True)]
    assert bad.count() == 2
    from paperledger.operators.extract import extract_bills

    scored = E.score(extract_bills(ok, text=F.col("text"), ocr_text=F.col("ocr_text"))).collect()
    assert {r["id"]: (r["ok_amount"], r["source"]) for r in scored}["s1"] == (True, "regex")
    for path in ("images/s1.png", "synthetic/s1.jpg", "synthetic/s4.pdf"):
        (tmp_path / "f" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / path).write_bytes(b"x")
    picked = E.resolve_manifest(readers.list_files(spark, str(tmp_path / "f")), ["images", "synthetic"], ["jpg", "jpeg", "png", "webp", "heic", "pdf"])
    assert {r["id"]: r["path"].split("/f/")[1] for r in picked.collect()} == {"s1": "images/s1.png", "s4": "synthetic/s4.pdf"}


def test_messages_of_the_wrong_shape_are_dropped(spark):
    def wrap(message):
        return '{"entry":[{"changes":[{"value":{"messages":[' + message + "]}}]}]}"

    raws = [
        wrap('{"from":"1","id":"a","timestamp":"1700000000","type":"text","text":{"body":"hi"}}'),
        wrap('{"from":"1","id":"b","type":"image","image":{"id":"p"}}'),
        wrap('{"from":1,"id":"c","type":"text","text":{"body":"hi"}}'),
        wrap('{"from":"1","id":"d","type":"text","text":{"body":5}}'),
        wrap('{"from":"1","id":"e","type":"audio"}'),
        '{"entry":[{"changes":[{"value":{"statuses":[]}}]}]}',
        '{"entry":[]}',
        "not json",
    ]
    out = readers.inbound_messages(spark.createDataFrame([(r,) for r in raws], "value string")).orderBy("wa_message_id").collect()
    assert [(r["wa_message_id"], r["kind"], r["text"], r["image_urls"]) for r in out] == [("a", "text", "hi", None), ("b", "photo", None, ["p"])]
    assert out[1]["wa_received_at"].timestamp() == 0


def test_dimension_insert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1)], "id string, n int")
    rows = spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int")
    once = L.add_missing(base, rows, ["id"])
    twice = L.add_missing(once, rows, ["id"])
    assert sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3)]


def test_criteria_without_data(spark):
    metrics = spark.createDataFrame(
        [(None, None, 0.96, None, 0, 0)],
        "success_rate double, amount_accuracy double, date_accuracy double, vendor_accuracy double, gst_n int, gst_correct int",
    )
    got = {r["criterion"]: (r["pass"], r["acceptable"]) for r in E.criteria(metrics).collect()}
    assert got == {"success": (False, True), "amount": (False, True), "date": (True, True), "vendor": (False, True), "gst": (False, True)}


def test_report_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame(
        [(0.9, 0.96, 0.96, 0.9, 3, 3)],
        "success_rate double, amount_accuracy double, date_accuracy double, vendor_accuracy double, gst_n int, gst_correct int",
    )
    histogram = spark.createDataFrame([(5, 2, 0)], "high int, partial int, low int")
    writers.write_report(writers.run_report(metrics, E.criteria(metrics), histogram), str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r")).head()
    assert back["gating"]["high"] == 5 and back["metrics"]["success_rate"] == 0.9
    assert [c["criterion"] for c in back["criteria"]] == ["amount", "date", "gst", "success", "vendor"]
    assert all(c["pass"] for c in back["criteria"])


def test_valid_and_quarantined_rows(spark):
    df = spark.createDataFrame([(1, "logged", "rent"), (2, "lost", "rent"), (3, "paid", None), (4, "lost", "x")], "id int, status string, category string")
    ok, bad = L.split_valid(df)
    assert [r["id"] for r in ok.orderBy("id").collect()] == [1, 3]
    assert {r["id"]: r["violations"] for r in bad.collect()} == {2: ["status"], 4: ["category", "status"]} or {
        r["id"]: sorted(r["violations"]) for r in bad.collect()
    } == {2: ["status"], 4: ["category", "status"]}


def test_plans_keep_their_shape(spark, sf_dir):
    from paperledger.plans.queries import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    # Ranked lists are cut before the shuffle.
    for name in ("logged_list", "search_bills", "top_vendors_by_business", "deletable_bills"):
        assert "WindowGroupLimit" in plan(name), name
    assert "TakeOrderedAndProject" in plan("top_vendors")
    # The text rules add no shuffle and no Python.
    text_plan = plan("garbage_texts") + plan("answered_bills")
    assert "Exchange" not in text_plan and "Python" not in text_plan
    # Columns are pruned down to the scan.
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("garbage_texts")
    for name in ("totals_by_user", "daily_summary", "visible_bills", "auto_log_decision"):
        assert "CartesianProduct" not in plan(name) and "NestedLoop" not in plan(name), name


def test_search_by_several_words(spark):
    from paperledger.operators import reports as R

    rows = [(1, "City Water", "utilities", 90.0, 8), (2, "City Water", "utilities", 91.0, 7), (3, "Harbour Gas", "rent", 1250.5, 8), (4, None, None, 5.0, 8)]
    made = [(i, "u", v, c, a, "logged", datetime(2025, m, 3)) for i, v, c, a, m in rows]
    bills = spark.createDataFrame(made, "bill_id int, user_id string, vendor string, category string, amount double, status string, confirmed_at timestamp")
    found = lambda words: {r["bill_id"] for r in R.search(bills, words).collect()}
    assert found("show august utilities") == {1} and found("find watr") == {1, 2} and found("august") == {1, 3, 4}
    assert found("$1,250.50") == {3} and found("city gas") == set()
