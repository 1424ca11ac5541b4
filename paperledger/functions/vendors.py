"""Known vendor names as a literal list; names kept in a table are matched by operators.vendors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperledger.functions.values import FOLD_FROM, FOLD_TO, fold_case, sql_text

# Vendor names known before anything is learned.
SEED_VENDORS = [
    "Telstra",
    "Origin Energy",
    "Bunnings",
    "Caltex",
    "Homebase",
    "Rajesh",
    "Reliance Hypermart Limited",
    "HDFC Bank",
    "Gujarat Freight Tools",
]


def learnable(name: Column) -> Column:
    """3 to 60 characters, up to eight words, one of them with three letters."""
    s = F.regexp_replace(F.btrim(name, F.lit(" \t\n\r\f\u000b")), r"\s+", " ")
    words = F.split(s, " ")
    letters = F.exists(words, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 3)
    return F.length(F.btrim(name, F.lit(" \t\n\r\f\u000b"))).between(3, 60) & (F.size(words) <= 8) & letters


def word_distance(left: Column, right: Column) -> Column:
    """Sum of word distances, or null when any word differs by more than one edit."""
    steps = F.zip_with(left, right, lambda a, b: F.levenshtein(a, b, 1))
    add = lambda total, d: F.when(d >= 0, total + d)
    return F.when(F.size(left) == F.size(right), F.aggregate(steps, F.lit(0), add))


def match_literal(name: Column, known: list[str]) -> Column:
    """The one nearest known name, or null when none or several are nearest."""
    known = list(dict.fromkeys(known))  # a repeated name doesn't tie with itself
    # By number of words: a name meets only those of as many words as it has.
    tables = {}
    for k in known:
        words = _shapes(k).split(" ")
        entry = f"struct({sql_text(k)} as name, {sql_text(_fold(k))} as folded, array({', '.join(map(sql_text, words))}) as words)"
        tables.setdefault(len(words), []).append(entry)
    if not tables:
        return F.lit(None).cast("string")

    def near(asked: Column) -> Column:
        table, n = F.lit(None), F.size(asked["words"])
        for size, entries in tables.items():
            table = F.when(n == size, F.expr(f"array({', '.join(entries)})")).otherwise(table)
        scored = F.transform(
            F.filter(table, lambda k: k["folded"] != asked["plain"]),
            lambda k: F.struct(word_distance(asked["words"], k["words"]).alias("d"), k["name"].alias("name")),
        )
        return F.filter(scored, lambda m: m["d"].isNotNull())

    def single(matches: Column) -> Column:
        # Sorted by distance: the first is the answer unless the second ties with it.
        first, second = F.get(matches, F.lit(0)), F.get(matches, F.lit(1))
        return F.when(~F.coalesce(first["d"] == second["d"], F.lit(False)), first["name"])

    # One-element arrays bind each intermediate value once.
    plain = F.filter(F.array(fold_case(name)), lambda p: p != "")
    asked = F.transform(plain, lambda p: F.struct(p.alias("plain"), F.split(F.translate(p, FOLD_FROM, FOLD_TO), " ").alias("words")))
    ordered = F.transform(F.transform(asked, near), lambda m: F.array_sort(m))
    return F.get(F.transform(ordered, single), F.lit(0))


def _fold(name: str) -> str:
    return re.sub("[^A-Z0-9]+", " ", name.upper()).strip()


def _shapes(name: str) -> str:
    return _fold(name).translate(str.maketrans(FOLD_FROM, FOLD_TO))
