"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Texts and regions (runs of words with a digit or an at sign) the field is fitted on; both are upper bounds.
TRAIN_DOCS, TRAIN_REGIONS, EPOCHS = 20_000, 400, 20
#: Composed data of each kind that the field is fitted on besides, in all its spellings.
COMPOSED = 40
#: Atoms of the longest segment; score by which an added span must beat leaving it out.
MAX_ATOMS, MARGIN = 26, 2.0

# The patterns of the contract. Possessive repeats and the look-behind change no match, but keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]")
_REGION = re.compile(r"[^\s0-9@]*+[0-9@]\S*+(?: (?:\. )?[^\s0-9@]*+[0-9@]\S*+)*+")
# An address spelled with words for its signs: the word "at" with what follows it; its local part stands before.
_AT = re.compile(r" ?[\[(]at[\])] ?| at ", re.I)
_DOT = r"(?: ?[\[(]dot[\])] ?| dot |\.)"
_SPELLED_DOMAIN = re.compile(rf"[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)+", re.I)
_SPELLED = re.compile(rf"[a-z0-9._%+-]+(?: ?[\[(]at[\])] ?| at ){_SPELLED_DOMAIN.pattern}", re.I)
_CONTINUES = re.compile(rf"{_DOT}[a-z0-9]", re.I)
_WORD_DOT = re.compile(r"[\[(]dot[\])]| dot ", re.I)
#: Words that announce each kind.
CUES = (
    frozenset("email mail contact write courriel correo".split()),
    frozenset("ip host server address addr login from".split()),
    frozenset("card visa mastercard amex credit debit carte tarjeta karte".split()),
    frozenset("phone tel telephone call mobile cell fax ring telefon tel\u00e9fono".split()),
)
_LAST_WORD = re.compile(r"([^\W\d_]+)[\s:.#]*\Z")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(x * 2 - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the fixed patterns: by kind, then start; code points."""
    if not _HINT.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Where an address may be spelled with words for its signs."""
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done or not (domain := _SPELLED_DOMAIN.match(text, m.end())):
            continue
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        # "look at example.org" is no address: one sign at least must be marked as spelled.
        if start < m.start() and (m[0].strip() not in ("at", "AT", "At") or _WORD_DOT.search(domain[0])):
            yield start, domain.end()
            done = domain.end()


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that each hold a digit or an at sign, and spelled addresses; spans are sought inside them.

    Regions that overlap are one.
    """
    found = [m.span() for m in _REGION.finditer(text)] if _HINT.search(text) else []
    if spelled := list(_spelled(text)):
        found = sorted(found + spelled)
    at = 0
    while at < len(found):
        a, b = found[at]
        at += 1
        while at < len(found) and found[at][0] < b:
            b = max(b, found[at][1])
            at += 1
        yield a, b


def cue_before(text: str, at: int) -> str:
    """The last word before a place, in lower case, if only blanks and marks stand between."""
    m = _LAST_WORD.search(text[max(0, at - 24) : at])
    return m[1].lower() if m else ""


def features(text: str, left: str, right: str, cue: str = "") -> list[float]:
    """Of a whole segment, the characters beside it (one to the left, some to the right) and the word before it."""
    digits = [x for x in text if "0" <= x <= "9"]
    n, dots = len(digits), text.count(".")
    parts = text.split(".")
    numbers = [p for p in parts if p.isascii() and p.isdigit()]
    bare = all(x in "0123456789 -" for x in text)
    at = text.count("@") == 1
    return [
        1.0,
        at,
        at and bool(re.fullmatch(r"[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+", text)),
        text[0] == "+",
        text[0] == "(" and ")" in text,
        n == 0,
        n < 7,
        7 <= n <= 15,
        16 <= n <= 19,
        n > 19,
        dots == 3 and len(numbers) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in numbers),
        dots == 3 and len(numbers) == 4,
        bare,
        bare and 16 <= n <= 19 and luhn("".join(digits)),
        text[-1].isalnum(),
        text[0].isalnum(),
        any(x.isalpha() for x in text) and not at,
        any(x in "=\":;/\\'<>,!?" for x in text),
        any(x.isspace() for x in text),
        text[0].isspace() or text[-1].isspace(),
        all(x in "0123456789 ().+-" for x in text),
        left == "" or left.isspace(),
        right == "" or right[0].isspace() or right[0] in ".,;:!?)",
        left.isalnum() or right[:1].isalnum(),
        bool(_AT.search(text)) and bool(_SPELLED.fullmatch(text)),
        bool(_AT.search(text)) and bool(_CONTINUES.match(right)),
        _is_spaced_ip(text),
        16 <= n <= 19 and luhn("".join(digits)) and all(x in "0123456789 -._/" for x in text),
        bool(_GROUPS_OF_FOUR.fullmatch(text)),
        bool(_LOCAL_PHONE.fullmatch(text)),
        bool(_ABROAD.fullmatch(text)) and 10 <= n <= 17,
        bool(_MORE_DIGITS.match(right)),
        bool(_DATE_LIKE.fullmatch(text)),
        *[cue in words for words in CUES],
    ]


_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_GROUPS_OF_FOUR = re.compile(r"[0-9]{4}(?:([ ./_-])[0-9]{4})(?:\1[0-9]{4})\1[0-9]{1,7}")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}")
_ABROAD, _MORE_DIGITS = re.compile(r"00[1-9][0-9]*(?:[ -][0-9]{2,4}){2,4}"), re.compile("[ ./_-]?[0-9]")
_DATE_LIKE = re.compile(r"[0-9]{1,4}([-/.:])[0-9]{1,2}\1[0-9]{1,4}")


def _is_spaced_ip(text: str) -> bool:
    """Four numbers below 256 whose dots stand in brackets or between blanks."""
    bare = text.replace("[.]", ".").replace("(.)", ".").replace(" . ", ".")
    return bare != text and bool(_QUAD.fullmatch(bare)) and all(int(x) <= 255 for x in bare.split("."))


N_FEATURES = 37


def segments(text: str, cue: str = "") -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
    """Cuts between atoms; the candidate segments as pairs of cuts, at most ``MAX_ATOMS`` long; their features.

    ``cue`` is the word before the text.
    """
    cuts = [0, *(m.end() for m in _ATOM.finditer(text))]
    spans, rows = [], []
    for i in range(len(cuts) - 1):
        if text[cuts[i]].isspace():
            continue
        for j in range(i + 1, min(len(cuts), i + 1 + MAX_ATOMS)):
            inside = text[cuts[i] : cuts[j]]
            if inside[-1].isspace() or not (_HINT.search(inside) or _AT.search(inside)):
                continue
            spans.append((i, j))
            before = cue_before(text, cuts[i]) if cuts[i] else cue
            rows.append(features(inside, text[cuts[i] - 1 : cuts[i]] if cuts[i] else "", text[cuts[j] : cuts[j] + 9], before))
    return cuts, spans, np.array(rows, float).reshape(-1, N_FEATURES)


def _by_end(n: int, spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for s, (_, j) in enumerate(spans):
        out[j].append(s)
    return out


def marginals(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """The chance of each segment and kind under the field; an atom outside any segment scores 0."""
    ends, forward, back = _by_end(n, spans), np.zeros(n), np.zeros(n)
    total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    for j in range(1, n):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[spans[s][0]] + total[s] for s in ends[j])])
    starts: list[list[int]] = [[] for _ in range(n)]
    for s, (i, _) in enumerate(spans):
        starts[i].append(s)
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce([back[i + 1], *(back[spans[s][1]] + total[s] for s in starts[i])])
    outside = np.array([forward[i] + back[j] for i, j in spans]) - forward[n - 1]
    return np.exp(scores + outside[:, None])


def best(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """``segment, kind`` of the best segmentation: boundaries and kinds are chosen together."""
    ends, value, back = _by_end(n, spans), np.zeros(n), [None] * n
    kinds = scores.argmax(axis=1) if len(scores) else []
    for j in range(1, n):
        value[j] = value[j - 1]
        for s in ends[j]:
            score = value[spans[s][0]] + scores[s, kinds[s]]
            if score > value[j]:
                value[j], back[j] = score, s
    out, j = [], n - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j], int(kinds[back[j]])))
            j = spans[back[j]][0]
    return out[::-1]


def spellings(kind: int, inside: str) -> list[str]:
    """Ways in which people write what the patterns of a kind miss."""
    digits = re.sub("[^0-9]", "", inside)
    if kind == 0:
        local, _, domain = inside.partition("@")
        return [f"{local}{at}{domain.replace('.', dot)}" for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."))]
    if kind == 1:
        return [inside.replace(".", dot) for dot in ("[.]", " . ", "(.)")]
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [mark.join(fours) for mark in "./_"]
    last = digits[-10:]
    local = [f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}"] if len(last) == 10 else []
    return [*local, f"00{digits[:-7]} {digits[-7:-4]} {digits[-4:]}"]


def variants(text: str, gold: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Other spellings of the labelled spans, each by itself."""
    for kind, a, b in gold:
        for other in spellings(kind, text[a:b]):
            yield other, [(kind, 0, len(other))]


def composed(seed: int, n: int = COMPOSED) -> list[tuple[int, str]]:
    """``kind, text`` of ``n`` made-up data of each kind, as the patterns find them."""
    rng = np.random.default_rng(seed)
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    numbers = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for _ in range(n):
        out.append((0, f"{letters(rng.integers(2, 9))}{rng.choice(['', '.', '_'])}{letters(3)}@{letters(rng.integers(3, 10))}.{rng.choice(['org', 'com', 'co.uk', 'net', 'de'])}"))
        out.append((1, ".".join(map(str, rng.integers(0, 256, 4)))))
        body = numbers(rng.integers(15, 19))
        out.append((2, body + next(x for x in "0123456789" if luhn(body + x))))
        out.append((3, f"+{rng.integers(1, 99)} {rng.integers(200, 999)} {rng.integers(200, 999)} {numbers(4)}"))
    return out


def ordinary(seed: int, n: int = COMPOSED) -> list[str]:
    """Made-up numbers that are nobody's: dates, times, versions, prices, sizes, plain counts and codes."""
    rng = np.random.default_rng(seed)
    r = lambda a, b: int(rng.integers(a, b))
    out = []
    for _ in range(n):
        day = (r(1, 29), r(1, 13), r(1950, 2050))
        out += ["{0:02}.{1:02}.{2}".format(*day), "{2}-{1:02}-{0:02} {3}:{4:02}:{5:02}".format(*day, r(0, 24), r(0, 60), r(0, 60)), "{0}/{1}/{2}".format(*day)]
        out += [f"{r(0, 20)}.{r(0, 50)}.{r(0, 99)}", f"{r(1, 9)}.{r(0, 9)}.{r(0, 9)}-{r(0, 9)}", f"${r(1, 999)},{r(100, 999)}.{r(10, 99)}", f"{r(1, 999)} {r(100, 999)} {r(100, 999)}"]
        out += [f"({r(1900, 2050)})", f"{r(10**9, 10**12)}", f"978-{r(0, 9)}-{r(10, 99)}-{r(10**5, 10**6)}-{r(0, 9)}", f"{r(1900, 2000)}-{r(2000, 2050)}", f"{r(10**15, 10**16)}x", f"{r(2, 90)}x{r(2, 90)}"]
    return out


def fit(examples: list[tuple[str, list[tuple[int, int, int]], str]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, feature by kind, that maximise the likelihood of the labelled regions, each with the word before it."""
    weights, squares = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-3)
    weights[0] = -4.0  # without evidence, nothing is personal
    ready = []
    for text, gold, cue in examples:
        cuts, spans, rows = segments(text, cue)
        at = {span: s for s, span in enumerate(spans)}
        place = {cut: k for k, cut in enumerate(cuts)}
        wanted = np.zeros((len(spans), len(KINDS)))
        for kind, a, b in gold:
            s = at.get((place.get(a), place.get(b)))
            if s is not None:
                wanted[s, kind] = 1
        if len(spans):
            ready.append((len(cuts), spans, rows, wanted))
    for _ in range(epochs):
        for n, spans, rows, wanted in ready:
            gradient = rows.T @ (wanted - marginals(n, spans, rows @ weights)) - 1e-4 * weights
            squares += gradient**2
            weights += 0.5 * gradient / np.sqrt(squares)
    return weights


def train(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS, train_regions: int = TRAIN_REGIONS) -> np.ndarray:
    """The field's weights, from a bounded sample: at most ``train_regions`` regions of about ``train_docs`` texts.

    The fixed patterns label the regions, half of which hold a span where the
    sample has as many. Other ``spellings`` of what they find, and composed
    data of all kinds (``composed``, ``ordinary``), are added, some of them
    behind a word that announces the kind. The sample is drawn by hashes, so a
    rerun fits the same weights. Regions of over 256 code points are not
    fitted on; spans are found in them as in others.
    """
    rows = docs.select(text_of(text_col).alias("text"))
    share = min(1.0, train_docs / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(text[a:b], bool(base_spans(text[a:b])), cue_before(text, a)) for text in batch["text"] for a, b in regions(text) if b - a <= 256]
            yield pd.DataFrame(found, columns=["region", "labelled", "cue"])

    found = rows.mapInPandas(cut, "region string, labelled boolean, cue string").groupBy("region").agg(F.max("labelled").alias("labelled"), F.min("cue").alias("cue"))
    part = lambda labelled: found.where(F.col("labelled") == labelled).orderBy(F.xxhash64("region"), "region").limit(train_regions // 2)
    examples = []
    for region, _, cue in sorted(map(tuple, part(True).unionByName(part(False)).collect())):
        gold = base_spans(region)
        examples.append((region, gold, cue))
        examples += [(text, spans, "") for text, spans in variants(region, gold)]
    for k, (kind, text) in enumerate(composed(1)):
        for j, other in enumerate([text, *spellings(kind, text)]):
            words = sorted(CUES[kind])
            examples.append((other, [(kind, 0, len(other))], words[(k + j) % len(words)] if (k + j) % 3 == 0 else ""))
    examples += [(text, [], "") for text in ordinary(2)]
    order = np.random.default_rng(3).permutation(len(examples))
    return fit([examples[k] for k in order])


def spans_of(text: str, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, base`` of all spans, by kind, then start. The field's spans never touch a base span."""
    base = base_spans(text)
    out = [(kind, a, b, True) for kind, a, b in base]
    for a, b in regions(text):
        cuts, spans, rows = segments(text[a:b], cue_before(text, a))
        for s, kind in best(len(cuts), spans, rows @ weights - margin):
            x, y = a + cuts[spans[s][0]], a + cuts[spans[s][1]]
            if all(y <= p or q <= x for _, p, q in base):
                out.append((kind, x, y, False))
    return [(KINDS[kind], a, b, given) for kind, a, b, given in sorted(out)]


def find_pii(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: ``kind, start, end, base`` of each span, by kind and start, in code points.

    Null and empty texts have no spans. Each row is read by itself and whole:
    repeated rows, ties, ids and other columns play no part. Empty tables give
    no row.
    """

    @F.pandas_udf("array<struct<kind: string, start: long, end: long, base: boolean>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "base"), x)) for x in spans_of(text, weights)] for text in texts])

    return docs.select(F.col(id_col).alias("doc_id"), find(text_of(text_col)).alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span as its kind in brackets; of spans that overlap, the first stands for all."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; a null text stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else masked(text, spans_of(text, weights)) for text in texts], dtype=object)

    return docs.withColumn(text_col, mask(F.col(text_col)))
