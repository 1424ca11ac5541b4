"""The corpus pipeline: language, repeated lines, near copies, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``docs``, with ``n_chars`` of the text as it is then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.llm import langid, pii
from paperledger.llm.common import fresh_path
from paperledger.llm.lines import line_dedup
from paperledger.llm.near import near_dedup
from paperledger.llm.packing import pack


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language of every whole text, as found by a model of all labelled documents, becomes its ``lang``.

    Documents in which none can be found go: null texts, those without a letter,
    and those of which the model knows nothing. Without a labelled document to
    learn from, only the first two kinds go.
    """
    return langid.known_language(docs, langid.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, an emptied one too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = line_dedup(docs, carry=others)
    return _counted(cleaned.select(*(F.col(f"rest.`{c}`") if c in others else F.col(c) for c in docs.columns)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a Jaccard of 0.8 or more), the document with the smallest id stays."""
    return near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses, numbers and the like are masked by their kind."""
    return _counted(pii.mask_pii(docs, pii.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of 1024: the pieces with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: No SQL expresses the models and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what each stage returns is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
