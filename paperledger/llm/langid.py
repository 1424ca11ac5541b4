"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents the model is fitted on, about (drawn by a hash of the text), and of each language at least, or all it has;
#: words of a language and n-grams of each length that it keeps; times a word must be seen. They bound the model, which every task gets a copy of.
TRAIN_DOCS, LEAST_DOCS, TOP_WORDS, TOP_GRAMS, MIN_COUNT = 20_000, 1_000, 20_000, 10_000, 2
#: Lengths of the n-grams an unseen word falls back to, longest first.
LENGTHS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a worker remembers.
MEMORY = 200_000

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _RUNS.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, n, gram, count`` over ``text, lang``: words with n = 0 and n-grams, added up per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch["text"], batch["lang"]):
                words[lang].update(words_of(text))
            rows: Counter = Counter()
            for lang, counts in words.items():
                for word, times in counts.items():
                    rows[lang, 0, word] += times
                    for n in LENGTHS:
                        for gram in grams_of(word, n):
                            rows[lang, n, gram] += times
            yield pd.DataFrame([(*key, times) for key, times in rows.items()], columns=["lang", "n", "gram", "count"])

    return docs.select("text", "lang").mapInPandas(count, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies: ``langs`` in order, and for each n a row of scores for each gram."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, int]], scores: np.ndarray):
        self.langs, self.tables, self.scores = langs, tables, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS, least_docs: int = LEAST_DOCS) -> Model:
    """A model from the rows with text and language. Without any, it knows no language.

    About ``train_docs`` rows are drawn by a hash of their text, whole texts
    each; a language that would get fewer than ``least_docs`` of them gets about
    as many, or all its rows. Counting is distributed; what comes to the driver
    is the model, bounded by ``top_words`` and ``top_grams`` for each language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = min(1.0, train_docs / max(1, sum(sizes.values())))
    rare = [(F.lit(lang), F.lit(int(min(1.0, least_docs / size) * 1_000_000))) for lang, size in sizes.items() if share * size < min(least_docs, size)]
    drawn = F.lit(int(share * 1_000_000))
    if rare:
        drawn = F.coalesce(F.try_element_at(F.create_map(*(x for pair in rare for x in pair)), F.col("lang")), drawn)
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < drawn)
    ranked = count_grams(rows).where(F.col("count") >= MIN_COUNT)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram")))
    table = ranked.where(F.col("rank") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams)).select("lang", "n", "gram", "count").toPandas()
    langs = sorted(table["lang"].unique())
    tables, blocks, first = {}, [], 0
    for n in (0, *LENGTHS):
        part = table[table["n"] == n]
        grams = sorted(part["gram"].unique())
        tables[n] = {gram: first + k for k, gram in enumerate(grams)}
        counts = np.zeros((len(grams), len(langs)))
        counts[part["gram"].map(tables[n]).to_numpy(dtype=np.int64) - first, part["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = part["count"]
        # Half a count for what a language hasn't shown.
        blocks.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(grams)))))
        first += len(grams)
    return Model(langs, tables, np.concatenate(blocks) if langs else np.zeros((0, 0)))


class Scorer(dict):
    """Row of a word in a growing matrix of scores, by language."""

    def __init__(self, model: Model):
        super().__init__(model.tables.get(0, {}))
        self.model, self.known = model, dict(model.tables.get(0, {}))
        self.rows = np.concatenate([model.scores, np.zeros((1024, len(model.langs)))]) if model.langs else model.scores
        self.used = len(model.scores)

    def __missing__(self, word: str) -> int:
        """An unseen word is the mean of its longest known n-grams, and nothing if none is known."""
        score = np.zeros(len(self.model.langs))
        for n in LENGTHS:
            found = [k for k in map(self.model.tables[n].get, grams_of(word, n)) if k is not None]
            if found:
                score = self.model.scores[found].mean(axis=0)
                break
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = score
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.langs or not has_letter(text):
            return "und", 0.0
        if len(self) > len(self.known) + MEMORY:
            self.clear()
            self.update(self.known)
            self.used = len(self.model.scores)
        rows = np.fromiter(map(self.__getitem__, words_of(text)), np.int64)
        total = self.rows[rows].sum(axis=0)
        best = int(np.argmax(total))  # of equals the first in alphabetical order
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predictor(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to ``lang_pred, score``; the model, of bounded size, goes to every task once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(text) for text in batch], columns=["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, a row for each row.

    ``und`` and 0 where the text is null or has no letter, or the model knows
    no language; ``score`` is the share of the best language. Only the text
    is read: other columns, ids and repeated rows play no part. Of languages
    that score alike, the first in the alphabet wins. Empty tables give no row.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), predictor(docs, model)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")


def evident(text: str | None, model: Model) -> bool:
    """Whether the model knows a word of the text, or an n-gram of one that is more than the mark of a word's end."""
    known = model.tables
    return text is not None and any(
        word in known[0] or any(gram in known[n] for n in LENGTHS for gram in grams_of(word, n) if gram not in "<>") for word in map(re.Match.group, _RUNS.finditer(text.lower()))
    )


def known_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which a language is found, with that language: with a letter, and a word or n-gram that the model knows.

    The language is the best of the whole text, whatever the row said before.
    If the model knows no language, only null and letterless texts go and
    ``lang_col`` stays as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.predict(text)[0] if has_letter(text) and evident(text, scorer.model) else None for text in texts], dtype=object)

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(text) for text in texts], dtype=bool)

    if not model.langs:
        return docs.where(lettered(F.col(text_col)))
    # Not to be moved: a filter on the result would have every text scored twice.
    return docs.withColumn(lang_col, found.asNondeterministic()(F.col(text_col))).where(F.col(lang_col).isNotNull())
