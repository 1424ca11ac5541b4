"""Toxicity by two Kneser-Ney models of spelling, one of toxic and one of ordinary texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import Remembered, bitmap, in_bitmap, text_of, written
from paperledger.llm.langid import words_of

#: Characters of the longest n-gram; a word is spelt between the marks < and >.
ORDER = 4
#: A window goes to every task if at least one in so many training positions has it, so no more than so many can; others are joined.
COMMON = 400_000
#: Labelled rows, about, on which the calibration is fitted; they are not counted in the models.
CALIBRATION = 20_000
#: Words whose windows a worker remembers, different windows it counts before it sends them on.
MEMORY, FLUSH = 150_000, 400_000
#: Bits of the map of labelled ids.
MAP_BITS = 1 << 23


def windows_of(word: str, order: int = ORDER) -> list[str]:
    """For each character of a word and its end mark, the n-gram that predicts it; shorter ones start the word."""
    marked = f"<{word}>"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def count_windows(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """``window, t, o``: how often each occurs in toxic and in ordinary rows of ``text, toxic``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: dict[str, list[int]]) -> pd.DataFrame:
            return pd.DataFrame({"window": list(rows), "t": [c[1] for c in rows.values()], "o": [c[0] for c in rows.values()]})

        rows: dict[str, list[int]] = {}
        for batch in batches:
            for toxic in (0, 1):
                words: Counter = Counter()
                for text in batch["text"][batch["toxic"] == toxic]:
                    words.update(words_of(text))
                for word, times in words.items():
                    for window in windows_of(word, order):
                        rows.setdefault(window, [0, 0])[toxic] += times
            if len(rows) > FLUSH:
                yield frame(rows)
                rows = {}
        if rows:
            yield frame(rows)

    counted = labelled.select("text", "toxic").mapInPandas(count, "window string, t long, o long")
    return counted.groupBy("window").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


@dataclass
class Model:
    """Counts of both classes as tables, and the bounded part of them that every task gets.

    ``grams[n]``: ``gram, t, o`` and ``contexts[n]``: ``context, ct, nt, co, no``
    (occurrences and different continuations of the first n - 1 characters);
    ``shared``: ``letter, preceded``, the different letters before each one, of
    both classes together; ``discounts[n]``: what KN takes off, by class.
    """

    order: int
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    shared: DataFrame
    shared_total: int
    letters: int
    discounts: dict[int, tuple[float, float]]
    known: bool
    rate: float
    common: dict[str, float]


def _labelled(docs: DataFrame, labels: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """Texts with their labels. Texts whose id isn't in a map of fixed size of the labelled ids aren't shuffled; ids that share a slot cost a needless row."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(map_bits))
    ids = bitmap(labels.select(slot.alias("slot")), map_bits)
    likely = docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("slot"), ids.alias("map")).where(in_bitmap("slot", "map"))
    return likely.select("doc_id", "text").join(labels.hint("merge"), "doc_id")


def _discount(ones: int, twos: int) -> float:
    """Kneser and Ney's estimate, kept off 0 and 1 where there are few rows."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, common: int = COMMON) -> Model:
    """Models from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``), of all rows that match.

    The counts stay tables, however large they grow. Windows of at least one
    ``common``-th of all training positions come to the driver with their
    log-ratios: there are at most ``common`` of them.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = written(count_windows(_labelled(docs, labels), order))
    totals = rows.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).head()
    t, o = totals["t"] or 0, totals["o"] or 0
    rate = labels.agg(F.avg("toxic").alias("rate")).head()["rate"] or 0.0
    grams, contexts, discounts = {}, {}, {}
    for n in range(1, order + 1):
        part = rows.where(F.length("window") >= n).groupBy(F.expr(f"substr(window, -{n})").alias("gram")).agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        grams[n] = part = written(part)
        ones = part.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "to" for k in (1, 2)]).head()
        discounts[n] = _discount(ones["t1"], ones["t2"]), _discount(ones["o1"], ones["o2"])
        contexts[n] = part.groupBy(F.expr(f"substr(gram, 1, {n - 1})").alias("context")).agg(
            F.sum("t").alias("ct"), F.count_if(F.col("t") > 0).alias("nt"), F.sum("o").alias("co"), F.count_if(F.col("o") > 0).alias("no"))
    shared = written(grams[2].groupBy(F.expr("substr(gram, -1)").alias("letter")).agg(F.count("*").alias("preceded")))
    base = shared.agg(F.sum("preceded").alias("total"), F.count("*").alias("letters")).head()
    model = Model(order, grams, contexts, shared, base["total"] or 0, base["letters"], discounts, t > 0 and o > 0, rate, {})
    if model.known:
        often = rows.where(F.col("t") + F.col("o") >= (t + o) / common).select("window")
        model.common = {r["window"]: r["ratio"] for r in log_ratios(often, model).collect()}
    return model


def log_ratios(windows: DataFrame, model: Model) -> DataFrame:
    """``window, ratio`` of different windows: log of its last character's probability by the toxic model over that by the ordinary one.

    Interpolated from the shared base upwards: each order takes its discount
    off what it has seen and gives it to the order below; an order whose
    context a class has never seen says nothing.
    """
    found = windows.withColumn("letter", F.expr("substr(window, -1)")).join(model.shared, "letter", "left")
    base = (F.coalesce("preceded", F.lit(0)) + 1) / F.lit(float(model.shared_total + model.letters + 1))
    found = found.select("window", base.alias("pt"), base.alias("po"))
    for n in range(1, model.order + 1):
        fits = F.length("window") >= n
        keyed = found.withColumns({"gram": F.when(fits, F.expr(f"substr(window, -{n})")), "context": F.when(fits, F.expr(f"substr(window, -{n}, {n - 1})"))})
        joined = keyed.join(model.grams[n], "gram", "left").join(model.contexts[n], "context", "left")

        def level(below: str, seen: str, total: str, different: str, discount: float) -> Column:
            taken = F.greatest(F.coalesce(seen, F.lit(0)) - F.lit(discount), F.lit(0.0))
            return F.when(F.col(total) > 0, (taken + F.lit(discount) * F.col(different) * F.col(below)) / F.col(total)).otherwise(F.col(below))

        found = joined.select("window", level("pt", "t", "ct", "nt", model.discounts[n][0]).alias("pt"), level("po", "o", "co", "no", model.discounts[n][1]).alias("po"))
    return found.select("window", (F.log("pt") - F.log("po")).alias("ratio"))


def likelihoods(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's ``doc_id, n, ratio``: words, and the sum of log-ratios over all their characters.

    A task adds up the common windows at once; only the others, few of each
    text, meet the tables, and each different one is computed once.
    """
    order, shared = model.order, docs.sparkSession.sparkContext.broadcast(model.common)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value

        def spell(word: str) -> tuple[float, tuple[str, ...]]:
            windows = windows_of(word, order)
            return sum(common.get(w, 0.0) for w in windows), tuple(w for w in windows if w not in common)

        words = Remembered(spell, MEMORY)
        for batch in batches:
            for first in range(0, len(batch), 500):
                rows = []
                for doc_id, text in zip(batch["doc_id"].iloc[first : first + 500], batch["text"].iloc[first : first + 500]):
                    n, ratio, rare = 0, 0.0, Counter()
                    for word in words_of(text):
                        n += 1
                        part, missing = words[word]
                        ratio += part
                        if missing:
                            rare.update(missing)
                    rows.append((doc_id, n, ratio, list(rare), list(rare.values())))
                yield pd.DataFrame(rows, columns=["doc_id", "n", "ratio", "rare", "times"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n long, ratio double, rare array<string>, times array<int>"
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInPandas(add, schema)
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()))
    asked = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("window"), F.col("x.times").alias("times"))
    ratios = written(log_ratios(asked.select("window").distinct(), model))
    rest = asked.join(ratios, "window").groupBy("row").agg(F.sum(F.col("times") * F.col("ratio")).alias("rest"))
    return parts.select("row", "doc_id", "n", "ratio").join(rest, "row", "left").select("doc_id", "n", (F.col("ratio") + F.coalesce("rest", F.lit(0.0))).alias("ratio"))


def features(n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What the calibration weighs: the log-ratio by word, by the root of words (its noise), and the length."""
    n = np.maximum(n, 1)
    return np.stack([ratio / n, ratio / np.sqrt(n), np.log(n), np.ones(len(n))], axis=1)


def calibrate(n: np.ndarray, ratio: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a small penalty; the first two weights can't fall below 0."""
    x = features(n, ratio)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(4)
    x, free = x / scale, np.array([True, True, True, True])
    for _ in range(3):
        w = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w[free], -30, 30)))
            slope = x[:, free].T @ (p - toxic) + 1e-3 * w[free]
            bend = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + 1e-3 * np.eye(int(free.sum()))
            step = np.linalg.solve(bend, slope)
            w[free] -= step * min(1, 10 / max(1e-9, np.abs(step).max()))
        if (w[:2] >= 0).all():
            break
        free[:2] &= w[:2] >= 0
    return w / scale


def toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, common: int = COMMON, calibration: int = CALIBRATION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, a row for each row of ``docs``; ``score`` is the likelihood of label 1.

    ``labels``: ``doc_id, toxic`` of the rows to learn from. A fifth of them,
    drawn by a hash of the id, about ``calibration`` rows at most, turn the
    length-normalised log-ratio into a probability; the models count all
    labelled rows that aren't of that fifth. Texts are lower-cased and read as
    runs of letters. A text without any gets the share of toxic labels, as
    every text does if the labels show one class only (0 without labels).
    Null texts are empty. Labels that are null or neither 0 nor 1 and null ids
    teach nothing; a text labelled twice counts twice. Repeated rows get the
    same score each; an empty table gives no row; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    model = fit(docs, labels.where(~fifth), order, common)
    if not model.known:
        score = F.lit(float(model.rate))
        return docs.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    found = written(likelihoods(docs, model))
    kept = labels.where(fifth)
    share = min(1.0, calibration / max(1, kept.count()))
    drawn = kept.where(F.pmod(F.xxhash64("doc_id", F.lit("drawn")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = found.where("n > 0").join(drawn, "doc_id").select("n", "ratio", "toxic").toPandas()
    if sample["toxic"].nunique() < 2:  # too few to calibrate: twice the likelihood by word is even odds
        weights = np.array([1.0, 0.0, 0.0, -float(np.log(2))])
    else:
        weights = calibrate(sample["n"].to_numpy(float), sample["ratio"].to_numpy(float), sample["toxic"].to_numpy(float))
    n = F.col("n").cast("double")
    odds = F.col("ratio") / n * float(weights[0]) + F.col("ratio") / F.sqrt(n) * float(weights[1]) + F.log(n) * float(weights[2]) + float(weights[3])
    score = F.when(n > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))).otherwise(F.lit(float(model.rate)))
    return found.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
