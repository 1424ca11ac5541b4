"""Rules that read fields out of bill text, as Columns over text or line arrays.

Java's ``\\b`` is Unicode-aware, so word edges are written as look-arounds on
the ASCII word class throughout.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperledger.functions.values import (
    BLANKS,
    number_text,
    parse_amount,
    plain_blanks,
    strip,
    two_decimals,
    unit_length,
)

START, END = r"(?<!\w)", r"(?!\w)"
LINE_BREAK = r"\r?\n"

# Words that label the amount owed, and the digits character
# recognition puts in place of their letters.
TOTAL_LABELS = [
    "total",
    "amount",
    "balance",
    "due",
    "please pay",
    "you owe",
    "to pay",
    "amount payable",
]
LOOKALIKES = {"t": "t1", "o": "o0", "a": "a4", "l": "l1", "e": "e8", "s": "s5"}

# Number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
    "lakh": 100000, "crore": 10000000, "million": 1000000, "billion": 1000000000,
}

# Category patterns in order of precedence. The outer words of the
# long alternations are bounded on one side only, as the rules define them.
CATEGORY_PATTERNS = [
    ("wages", rf"{START}wages?{END}"),
    ("wages", rf"{START}salary{END}"),
    ("rent", rf"{START}rent{END}"),
    ("utilities", rf"{START}electricity|power|water|gas|phone|internet|energy|utilities?{END}"),
    ("inventory", rf"{START}inventory|stock|supplies|supplier|materials{END}"),
    ("misc", rf"{START}misc{END}"),
]

# Heading words that are never part of a vendor name.
HEADING_WORDS = (
    "gst inc incl inclusive exclusive tax bill invoice inv receipt total amount subtotal balance "
    "due date account page number no abn acn phone email pay paid payment thank please business "
    "customer address pty ltd you for your"
).split()
# Punctuation trimmed from both ends of a word.
WORD_EDGES = "-$€–—•|_*:;.,()[]'\"“”#"

MAX_VENDOR = 60


# --- whole text -------------------------------------------------------------


def lines_of(text: Column) -> Column:
    """The text cut at line breaks; a split by one plain character needs no pattern."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def mentions(low: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds any of the words, also inside others.

    A plain search costs a small part of a pattern, so it goes before patterns
    that need one of the words to match.
    """
    return reduce(operator.or_, [F.contains(low, F.lit(w)) for w in words])


def rejoin_wraps(text: Column) -> Column:
    """Join a lower-case word that a line break split at a hyphen."""
    # Fixed value: what counts as a split word.
    wrapped = r"(?<![A-Za-z'-])([A-Za-z]*[a-z])-[ \t]*\r?\n([a-z]{2,})"
    return F.when(F.contains(text, F.lit("-")), F.regexp_replace(text, wrapped, "$1$2")).otherwise(text)


def is_garbage(text: Column) -> Column:
    """Mostly one- and two-letter fragments: a misread photo, not a reading."""
    plain = plain_blanks(text)
    words = F.regexp_count(plain, F.lit(r"(?<!\S)[A-Za-z]++(?!\S)"))
    short = F.regexp_count(plain, F.lit(r"(?<!\S)[A-Za-z]{1,2}(?!\S)"))
    return F.coalesce((words >= 8) & (short * 2 >= words), F.lit(False))


# The shapes of dates that are read, and those that are only kept out of amounts.
_ISO_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_DASH_MONTH = r"\d{1,2}-[A-Za-z]{3}-\d{2,4}"
_BLANK_MONTH = r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}"
_LOOSE_DAY = r"\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2,4}"


def _words(*shapes: str) -> str:
    # Every shape starts with a digit: the look ahead spares the look back elsewhere.
    return rf"(?=\d){START}(?:{'|'.join(s + END for s in shapes)})"


PLAIN_DATE = _words(
    _ISO_DAY,
    r"\d{1,2}/\d{1,2}/\d{2,4}",
    _DASH_MONTH,
    r"\d{1,2}-\d{1,2}-\d{2,4}",
    r"\d{1,2}\.\d{1,2}\.\d{2,4}",
)
LABELLED_DATE = _words(_BLANK_MONTH, _LOOSE_DAY)
DATE_LABEL = rf"(?i){START}dated?{END}"
DATE_FRAGMENT = _words(
    _ISO_DAY,
    r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}",
    _DASH_MONTH,
    r"\d{1,2}[/\-]\d{1,2}\s+\d{2,4}",
    r"\d{1,2}:\d{2}",
    _BLANK_MONTH,
    _LOOSE_DAY,
)


def find_date(text: Column) -> Column:
    """First plain date anywhere, else a loose one on a line labelled as date."""
    plain = F.nullif(F.regexp_extract(text, PLAIN_DATE, 0), F.lit(""))
    labelled = F.filter(
        F.transform(
            F.filter(lines_of(text), lambda l: l.rlike(DATE_LABEL)),
            lambda l: F.regexp_extract(l, LABELLED_DATE, 0),
        ),
        lambda d: d != "",
    )
    return F.coalesce(plain, F.when(text.rlike(DATE_LABEL), F.get(labelled, F.lit(0))))


def strip_dates(text: Column) -> Column:
    return F.regexp_replace(text, DATE_FRAGMENT, " ")


def date_fragments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE_FRAGMENT), F.lit(0))


def find_abn(text: Column) -> Column:
    shape = rf"(?=\d){START}\d{{2}}\s?\d{{3}}\s?\d{{3}}\s?\d{{3}}{END}"
    return F.nullif(F.regexp_extract(text, shape, 0), F.lit(""))


def gst_basis(text: Column, low: Column | None = None) -> Column:
    """``low`` is the text in lower case, if at hand."""
    low = F.lower(text) if low is None else low
    # Wordings of a price with and without tax.
    inclusive = rf"(?i)gst\s*inclusive|{START}inc\s*gst|{START}gst\s*inc{END}"
    return (
        F.when(F.contains(low, F.lit("gst")) & F.contains(low, F.lit("inc")) & text.rlike(inclusive), "inclusive")
        .when(mentions(low, ["gst", "tax"]) & text.rlike(rf"(?i){START}(?:gst|tax){END}"), "exclusive")
        .otherwise("none")
    )


def _needed(pattern: str) -> list[str]:
    """What a text must hold one of for a category pattern: its words without their optional letters."""
    return [re.sub(r"\w\?", "", word) for word in pattern.replace(START, "").replace(END, "").split("|")]


def category_of(text: Column, low: Column | None = None) -> Column:
    """``low`` is the text in lower case, if at hand."""
    low = F.lower(text) if low is None else low
    found = F.lit(None).cast("string")
    for category, pattern in reversed(CATEGORY_PATTERNS):
        found = F.when(mentions(low, _needed(pattern)) & text.rlike(f"(?i){pattern}"), category).otherwise(found)
    return found


# --- amount -----------------------------------------------------------------

# How a marked and a bare amount look.
_TAIL = r"\s*[\d,]+(?:\.\d{1,2})?"
PREFIXED_AMOUNT = rf"\${_TAIL}|{START}AUD{_TAIL}|{START}(?:Rs|INR)\.?{_TAIL}|₹{_TAIL}"
# Possessive groups keep a refused number from matching again in a shorter form.
_BARE_AMOUNT = rf"(?>{START}\d{{1,3}}(?:,\d{{3}})+(?:\.\d{{1,2}})?|{START}\d+(?:\.\d{{1,2}})?{END})"


def _behind_postal() -> str:
    """``)`` and a dash within the last twelve characters, blanks aside."""
    return "|".join(rf"\)\s{{0,{10 - n}}}-\s{{{n}}}" for n in range(11))


def _behind_label() -> str:
    """A No/Number label within the last twelve characters."""
    shapes = []
    for word in ("no", "number"):
        for mark in ("", r"\.", ":", r"\.:"):
            room = 12 - len(word) - len(mark.replace("\\", ""))
            shapes.append(rf"(?<!\w){word}{mark}\s{{0,{room - 1}}}")
            # A label that fills the whole window starts it, whatever is before.
            shapes.append(rf"{word}{mark}\s{{{room}}}")
    return "|".join(shapes)


# Group 1 is empty for a bare number that is glued to a date separator, part of
# a comparison, a postal code or a reference number.
ANY_AMOUNT = (
    rf"({PREFIXED_AMOUNT}"
    rf"|(?=\d)(?<![/\-:<>])(?<!{_behind_postal()})(?<!(?i:{_behind_label()})){_BARE_AMOUNT}(?![/\-:<>]))"
    rf"|{_BARE_AMOUNT}"
)


def _total_pattern() -> str:
    words = []
    for label in TOTAL_LABELS:
        parts = ["".join(f"[{LOOKALIKES.get(c, c)}]" for c in part) for part in label.split()]
        words.append(r"\s+".join(parts))
    first = "".join(sorted({c for label in TOTAL_LABELS for c in LOOKALIKES.get(label[0], label[0])}))
    return rf"(?i)(?=[{first}])(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


TOTAL_LINE = _total_pattern()


def prefixed_on(line: Column) -> Column:
    """Currency amounts on one line; any case, unlike the whole-text pass."""
    return F.regexp_extract_all(line, F.lit(f"(?i)(?=[$₹ari])(?:{PREFIXED_AMOUNT})"), F.lit(0))


def content_lines(text: Column) -> Column:
    return F.filter(lines_of(text), lambda l: strip(l) != "")


def total_amount(lines: Column, low: Column) -> Column:
    """Largest amount on a total-like line, or on the line below an empty one; credit lines offer none.

    ``low`` is the text in lower case. Only lines that can offer are searched for amounts.
    """
    credit = lambda line: F.contains(low, F.lit("credit")) & line.rlike("(?i)credit")

    def offered(line: Column, i: Column) -> Column:
        below = F.get(lines, i + 1)
        next_one = F.when(~credit(below), prefixed_on(below))
        own = F.transform(F.array(prefixed_on(line)), lambda c: F.when(F.size(c) > 0, c).otherwise(next_one))
        return F.when(line.rlike(TOTAL_LINE) & ~credit(line), F.get(own, F.lit(0)))

    taken = F.flatten(F.filter(F.transform(lines, offered), lambda c: c.isNotNull()))
    return F.array_max(F.transform(taken, parse_amount))


def all_amounts(text: Column) -> Column:
    """Amount candidates of the whole text in order, refused ones as ``''``."""
    return F.regexp_extract_all(text, F.lit(ANY_AMOUNT), F.lit(1))


def _is_prefixed(candidate: Column) -> Column:
    return ~candidate.rlike(r"\A\d")


def first_prefixed(candidates: Column) -> Column:
    """The first currency amount, if it can be read."""
    marked = F.filter(candidates, lambda c: (c != "") & _is_prefixed(c))
    return parse_amount(F.get(marked, F.lit(0)))


def first_readable(candidates: Column) -> Column:
    """The first candidate that can be read; a lone digit is never an amount."""
    numbers = F.transform(F.filter(candidates, lambda c: F.length(c) > 1), parse_amount)
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))


# --- amounts in words -------------------------------------------------------

# Currency words and their fractions.
CURRENCY_WORD = rf"{START}(?:RUPEES?|DOLLARS?|INR){END}"
_BEFORE_CURRENCY = rf"(?is)\A(.*?){CURRENCY_WORD}"
_FRACTION = rf"(?is)\A.*?{CURRENCY_WORD}.*?{START}(?:AND\s+)?([A-Z]+)\s*(?:PAISA|CENTS?){END}"


def number_word(token: Column) -> Column:
    """Value of a number word, allowing one wrong letter from three letters on."""
    pairs = [(w, float(v)) for w, v in NUMBER_WORDS.items()]
    exact = F.expr(f"map({', '.join(f'{w!r}, {v}D' for w, v in pairs)})")[token]
    words = F.expr(f"array({', '.join(f'struct({w!r} as w, {v}D as v)' for w, v in pairs)})")
    near = F.filter(words, lambda x: F.levenshtein(x["w"], token, 1) == 1)
    return F.coalesce(exact, F.when(F.length(token) >= 3, F.get(near, F.lit(0))["v"]))


def words_value(words: Column) -> Column:
    """Number written in words, or null as soon as one word is no number."""
    tokens = F.filter(
        F.split(F.lower(words), r"[\s-]+"), lambda t: ~t.isin("", "and", "only")
    )
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("run"))

    def after(state: Column, value: Column) -> Column:
        total, run = state["total"], state["run"]
        scaled = F.when(run == 0, 1.0).otherwise(run) * value
        # A null value makes the total null for good.
        return F.when(
            value >= 1000, F.struct((total + scaled).alias("total"), F.lit(0.0).alias("run"))
        ).otherwise(
            F.struct(
                (total + value * 0).alias("total"),
                F.when(value < 100, run + value).otherwise(run * value).alias("run"),
            )
        )

    def step(state: Column, token: Column) -> Column:
        # The one-element array binds the word's value once; behind a word that is no number, none is looked up.
        found = F.get(F.transform(F.array(number_word(token)), lambda value: after(state, value)), F.lit(0))
        return F.when(state["total"].isNotNull(), found).otherwise(state)

    total = F.aggregate(tokens, start, step, lambda s: s["total"] + s["run"])
    return F.when(F.size(tokens) > 0, total)


def spells(low: Column) -> Column:
    """Whether a lower-cased text can hold a currency word."""
    return mentions(low, ["rupee", "dollar", "inr"])


def words_whole(line: Column) -> Column:
    """Whole currency units written in words on a line, or null."""
    return F.when(
        line.rlike(f"(?i){CURRENCY_WORD}"), words_value(F.regexp_extract(line, _BEFORE_CURRENCY, 1))
    )


def words_amount(text: Column, low: Column) -> Column:
    """Largest amount written in words on any line, with its paisa or cents."""

    def amount(line: Column) -> Column:
        cents = words_value(F.regexp_extract(line, _FRACTION, 1))
        part = F.when(cents < 100, cents / 100).otherwise(0.0)
        return words_whole(line) + part

    lines = F.filter(lines_of(text), lambda l: l.rlike(f"(?i){CURRENCY_WORD}"))
    return F.when(spells(low) & text.rlike(f"(?i){CURRENCY_WORD}"), F.array_max(F.transform(lines, amount)))


# --- vendor -----------------------------------------------------------------

_HEADING = rf"(?i){START}(?:{'|'.join(HEADING_WORDS)})(?!'s){END}"
_NUMBER_ONLY = r"\A[\d,]+(?:\.\d{1,2})?\z"


def clean_words(line: Column) -> Column:
    """Words of a line that can belong to a vendor name."""
    trimmed = F.transform(F.split(line, r"\s+"), lambda w: F.btrim(w, F.lit(WORD_EDGES)))
    return F.filter(trimmed, _keeps)


def _keeps(word: Column) -> Column:
    return (word != "") & ~word.rlike(_HEADING) & ~word.rlike(_NUMBER_ONLY)


def has_clean_word(text: Column) -> Column:
    """Whether any word survives, stopping at the first that does."""
    return F.exists(F.split(text, r"\s+"), lambda w: _keeps(F.btrim(w, F.lit(WORD_EDGES))))


def letter_ratio_ok(line: Column) -> Column:
    """At least seven tenths of the visible characters are letters."""
    visible = F.regexp_replace(line, r"\s+", "")
    letters = F.length(F.regexp_replace(line, r"[^A-Za-z]+", ""))
    return F.coalesce(F.try_divide(letters.cast("double"), unit_length(visible)) >= 0.7, F.lit(False))


def clean_vendor_line(line: Column, words: Column, low: Column) -> Column:
    """A line that looks like a shop name; ``words`` are its joined clean words, ``low`` the text in lower case."""
    return (
        (words != "")
        & (F.length(words) <= MAX_VENDOR)
        & words.rlike(r"\S{3}")
        & letter_ratio_ok(line)
        & (~spells(low) | words_whole(line).isNull())
    )


def replace_first(text: Column, pattern: Column | str) -> Column:
    """Blank out the first match only; ``pattern`` may differ per row.

    The plain search in front is many times cheaper on a text without a match
    than walking it with a growing prefix. ``text`` should be a bare column.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    upto = F.concat(F.lit(r"\A([\s\S]*?)(?:"), p, F.lit(")"))
    return F.when(F.regexp_like(text, p), F.regexp_replace(text, upto, F.lit("$1 "))).otherwise(text)


def without_word_amounts(text: Column, low: Column) -> Column:
    """Empty the lines that only spell out an amount."""
    blanked = F.transform(
        lines_of(text), lambda l: F.when(words_whole(l).isNotNull(), "").otherwise(l)
    )
    return F.when(spells(low) & text.rlike(f"(?i){CURRENCY_WORD}"), F.array_join(blanked, "\n")).otherwise(text)


def before_amount(text: Column, money: Column) -> Column:
    """What stands before the first copy of an amount with two decimals (``money``); null without a copy."""
    at = F.position(money, text)
    return F.when(at > 0, F.left(text, at - 1))


def without_amount(text: Column, before: Column, money: Column) -> Column:
    """Blank out the first copy of an amount with two decimals, with its sign.

    The same as ``replace_first`` by ``\\$?\\s?`` and the amount: the amount has
    one point, so copies don't overlap and the first copy is the first match.
    """
    n = F.length(before)
    blank = F.substring(before, -1, 1).isin(*BLANKS)
    signed = F.when(blank, F.substring(before, -2, 1) == "$").otherwise(F.endswith(before, F.lit("$")))
    cut = n - blank.cast("int") - F.when(blank & (n < 2), 0).otherwise(signed.cast("int"))
    after = F.substring(text, n + F.length(money) + 1, F.length(text))
    return F.when(before.isNotNull(), F.concat(F.left(before, cut), F.lit(" "), after)).otherwise(text)


def without_number(text: Column, plain: Column) -> Column:
    """Blank out the first copy of an amount as a plain number (``plain``), with its sign."""
    # The digits before the point are looked for first: a pattern that differs per row is compiled per row.
    whole = F.substring_index(plain, ".", 1)
    may = F.contains(text, whole) | whole.rlike("[A-Za-z]")
    return F.when(may, replace_first(text, F.concat(F.lit(r"(?i)\$?\s?"), plain))).otherwise(text)


# Currency marks, each behind the words that a text needs for it.
CURRENCY_PATTERNS = [(["aud"], r"(?i)AUD\s*"), (["rs", "inr"], rf"(?i){START}(?:Rs|INR)\.?\s*")]


def without_category(text: Column, category: Column) -> Column:
    """Drop the first category word, for the first pattern of that category."""
    out = F.lit(None).cast("string")
    first = {}
    for name, pattern in CATEGORY_PATTERNS:
        first.setdefault(name, pattern)
    for name, pattern in first.items():
        out = F.when(category == name, replace_first(text, f"(?i){pattern}")).otherwise(out)
    return out


def vendor_block(lines: Column, remainder_lines: Column, low: Column) -> Column:
    """First run of clean lines, at most sixty characters, or ``''``."""
    state = F.struct(F.lit("").alias("block"), F.lit(False).alias("done"))
    indexed = F.transform(lines, lambda l, i: F.struct(l.alias("line"), i.alias("i")))

    def step(acc: Column, item: Column) -> Column:
        block = acc["block"]
        rest = F.coalesce(F.get(remainder_lines, item["i"]), F.lit(""))

        def extend(found: Column) -> Column:
            words, good = found["words"], found["good"]
            fits = (block == "") | (F.length(block) + F.length(words) + 1 <= MAX_VENDOR)
            joined = F.when(block == "", words).otherwise(F.concat(block, F.lit(" "), words))
            return (
                F.when(good & fits, F.struct(joined.alias("block"), F.lit(False).alias("done")))
                .when(~good & (block == ""), acc)
                .otherwise(F.struct(block.alias("block"), F.lit(True).alias("done")))
            )

        # One-element arrays bind the words, and what they are worth, once.
        words = F.array(F.array_join(clean_words(rest), " "))
        judged = F.transform(words, lambda w: F.struct(w.alias("words"), clean_vendor_line(item["line"], w, low).alias("good")))
        return F.when(acc["done"], acc).otherwise(F.get(F.transform(judged, extend), F.lit(0)))

    return F.aggregate(indexed, state, step, lambda s: s["block"])
