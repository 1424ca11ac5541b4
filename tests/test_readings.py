"""Bill texts composed from words, amounts and dates whose truth is known, one set for each rule's boundaries."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paperledger.functions import text as X
from paperledger.functions.values import strip
from paperledger.operators.extract import extract_bills, read_text

RNG = random.Random(2024)
NAMES = ["Quill Traders", "Paddock", "Ember Lane Studio", "Wicker", "Tallow Works", "Juniper Forge"]
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def in_words(n):
    for unit, name in ((10_000_000, "crore"), (100_000, "lakh"), (1000, "thousand"), (100, "hundred")):
        if n >= unit:
            rest = n % unit
            return f"{in_words(n // unit)} {name}" + (f" {in_words(rest)}" if rest else "")
    return SMALL[n] if n < 20 else TENS[n // 10] + (f"-{SMALL[n % 10]}" if n % 10 else "")


def money(low, high):
    return RNG.randint(low * 100, high * 100) / 100


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["reading"] for r in read_text(rows, F.col("t")).orderBy("i").collect()]


def graded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["extraction"] for r in extract_bills(rows, ocr_text=F.col("t")).orderBy("i").collect()]


def check(spark, cases, field, run=read):
    found = run(spark, [text for text, _ in cases])
    wrong = [(text, want, got[field]["value"]) for (text, want), got in zip(cases, found) if got[field]["value"] != want]
    assert not wrong, wrong[:5]


def test_every_shape_of_a_date(spark):
    cases = []
    for k in range(40):
        day = date(2001, 1, 1) + timedelta(days=RNG.randint(0, 9000))
        month = day.strftime("%B")
        shape = [f"{day:%d/%m/%Y}", f"{day.day}-{day.month}-{day.year}", f"{day:%d.%m.%Y}", day.isoformat(), f"{day.day}-{month[:3]}-{day.year}", f"{day:%d/%m}/{day.year % 100:02}"][k % 6]
        cases.append((f"{RNG.choice(NAMES)}\nDate: {shape}\nTotal $10.00", day.isoformat()))
    check(spark, cases, "date", graded)


def test_days_that_do_not_exist_are_no_dates(spark):
    cases = [(f"{RNG.choice(NAMES)} {d}/{m}/2019 Total $10.00", None) for d, m in [(30, 2), (29, 2), (31, 4), (31, 6), (31, 9), (31, 11), (32, 1), (0, 5), (5, 13)]]
    check(spark, [*cases, ("Wicker 29/2/2020 Total $10.00", "2020-02-29")], "date", graded)


def test_long_dates_need_a_label(spark):
    cases = []
    for _ in range(12):
        day = date(2010, 1, 1) + timedelta(days=RNG.randint(0, 4000))
        words = f"{day.day} {day:%B} {day.year}"
        cases += [(f"DATED {words}\nTotal $5.50", words), (f"Received {words}\nTotal $5.50", None)]
    check(spark, cases, "date")


@pytest.mark.parametrize("label", X.TOTAL_LABELS)
def test_the_largest_labelled_amount_wins(spark, label):
    cases = []
    for _ in range(5):
        low, high, far = sorted(money(10, 900) for _ in range(3))
        name = RNG.choice(NAMES)
        # The largest number stands on a line without a label, or on a credit line.
        cases += [(f"{name}\nTable 4 ${far:.2f}\n{label}: ${low:.2f}\n{label.upper()} AUD {high:.2f}", high),
                  (f"{name}\n{label} ${high:.2f}\nCredit {label} ${far:.2f}", high),
                  (f"{name}\n{label}\n\nRs {low:.2f}\nTable ${far:.2f}", low)]
    check(spark, cases, "amount")


def test_labels_that_were_misread(spark):
    swaps = {"t": "1", "o": "0", "a": "4", "l": "1", "e": "8", "s": "5"}
    cases = []
    for label in X.TOTAL_LABELS:
        for k in [k for k, c in enumerate(label) if c in swaps]:
            cases.append((f"Wicker $1.25\n{label[:k]}{swaps[label[k]]}{label[k + 1:]} $9.75", 9.75))
            cases.append((f"Wicker $1.25\nx{label} $9.75", 1.25))  # part of a longer word
    check(spark, cases, "amount")


def test_the_first_marked_amount_without_a_label(spark):
    marks = ["$", "AUD ", "Rs ", "Rs. ", "INR ", "₹"]
    cases = []
    for mark in marks:
        first, later = money(1, 50), money(60, 900)
        cases.append((f"{RNG.choice(NAMES)} {mark}{first:.2f} and {mark}{later:.2f}", first))
    check(spark, [*cases, ("Wicker rs 14.50", 14.5), ("Wicker 7 rs", None)], "amount")


def test_amounts_in_words(spark):
    numbers = [1, 13, 20, 47, 100, 305, 999, 1000, 4016, 60_700, 100_000, 230_450, 10_000_000, *(RNG.randint(1, 9_999_999) for _ in range(25))]
    cases = [(f"{RNG.choice(NAMES)}\n{in_words(n).upper()} {RNG.choice(['RUPEES', 'DOLLARS', 'INR'])} ONLY", float(n)) for n in numbers]
    for n in numbers[:8]:
        part = RNG.choice([5, 11, 40, 90])
        cases.append((f"{in_words(n)} rupees and {in_words(part)} paisa only", n + part / 100 if part != 11 else n + 0.11))
    cases += [(f"Wicker\n{in_words(n)} pieces", None) for n in numbers[:5]]
    check(spark, cases, "amount")


def test_number_words_with_one_wrong_letter(spark):
    cases = []
    for n in (8, 30, 70, 300, 5000, 40_000, 17, 90):
        words = in_words(n).split()
        longest = max(words, key=len)
        bad = longest[0] + "q" + longest[2:]
        twice = longest[0] + "qq" + longest[3:]
        cases.append((" ".join(bad if w == longest else w for w in words) + " dollars", float(n)))
        cases.append((" ".join(twice if w == longest else w for w in words) + " dollars", None))
    check(spark, cases, "amount")


def test_bare_numbers_and_what_they_may_not_touch(spark):
    cases = []
    for number in ("36", "208.5", "1,750"):
        value = float(number.replace(",", ""))
        cases.append((f"lunch {number}", value))
        cases += [(f"lunch {left}{number}{right}", None) for left, right in (("/", ""), ("", "/"), ("-", ""), ("", "-"), (":", ""), ("", ":"), ("<", ""), ("", ">"))]
        cases += [(f"lunch {label} {number}", None) for label in ("No", "no.", "Number", "NUMBER:")]
        cases.append((f"lunch (North) - {number}", None))
        cases.append((f"lunch number that we kept {number}", value))  # the label is out of reach
    check(spark, [*cases, ("lunch 7", None), ("lunch 7.5", 7.5), ("lunch 18:45 36", 36.0)], "amount")


def test_words_that_a_line_break_split(spark):
    texts = [f"{a}-{gap}{b}\nTotal $10.00" for a, b, gap in [("Ember", "light", "\n"), ("Tal", "low", "\r\n"), ("Juni", "per", " \n")]]
    kept = ["Ember-\nLight", "EMBER-\nlight", "Ember-\nl 5", "co-em-\nber"]
    rows = spark.createDataFrame(list(enumerate([*texts, *kept])), "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(X.rejoin_wraps(F.col("t"))).collect()]
    assert [g.split("\n")[0] for g in got[:3]] == ["Emberlight", "Tallow", "Juniper"]
    assert got[3:6] == kept[:3]


def test_garbage_begins_at_eight_words_half_of_them_short(spark):
    cases = []
    for total in range(5, 14):
        for short in range(total + 1):
            words = ["ab"] * short + ["abcd"] * (total - short)
            RNG.shuffle(words)
            cases.append((" ".join(words), total >= 8 and 2 * short >= total))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(X.is_garbage(strip(F.col("t")))).collect()] == [want for _, want in cases]


def business_number(rng):
    """Eleven digits whose weighted sum is a multiple of 89 once the first is one less."""
    weights = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
    while True:
        digits = [rng.randint(1, 9), *(rng.randint(0, 9) for _ in range(10))]
        if sum(w * (d - (k == 0)) for k, (w, d) in enumerate(zip(weights, digits))) % 89 == 0:
            return "".join(map(str, digits))


def test_business_numbers_need_their_check_sum(spark):
    cases = []
    for _ in range(10):
        n = business_number(RNG)
        spaced = f"{n[:2]} {n[2:5]} {n[5:8]} {n[8:]}"
        off = spaced[:-1] + str((int(spaced[-1]) + 1) % 10)
        cases += [(f"Wicker ABN {spaced} Total $4.40", spaced), (f"Wicker ABN {off} Total $4.40", None)]
    found = [e["abn"]["value"] for e in graded(spark, [text for text, _ in cases])]
    assert [f and f.replace(" ", "") for f in found] == [want and want.replace(" ", "") for _, want in cases]


def test_names_around_the_facts(spark):
    cases = []
    for name in NAMES:
        amount = money(20, 400)
        cases += [(f"{name}\n14/03/2022\nTotal: ${amount:.2f}", name), (f"14/03/2022 {name} ${amount:.2f}", name), (f"{name} ${amount:.2f} inc GST", name)]
    cases += [("***\n12 34\nWicker\nTotal $3.30", "Wicker"), ("$3.30", None), ("", None)]
    check(spark, cases, "vendor")
