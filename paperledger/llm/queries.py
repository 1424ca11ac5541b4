"""The registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.llm import conversations, langid, pieces, pii, twins
from paperledger.llm import toxicity as toxic
from paperledger.llm.centroids import cluster
from paperledger.llm.exact import exact_dedup
from paperledger.llm.fingerprints import fingerprints
from paperledger.llm.lines import line_dedup
from paperledger.llm.packing import pack
from paperledger.llm.pages import extract
from paperledger.llm.simhash import near_components
from paperledger.llm.substrings import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays in its place."""
    return exact_dedup(_documents(spark, folder), digests=True)


ORACLES["op1_exact_dedup"] = r"""
WITH bodies AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM bodies WINDOW same AS (PARTITION BY text_sha256)
"""


@_query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    return line_dedup(_documents(spark, folder)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), judged AS (
    SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@_query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    pieces = pack(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the smallest document that near links lead to."""
    found = near_components(_documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's personal data."""
    docs = _documents(spark, folder)
    found = pii.find_pii(docs, pii.train(docs))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [number(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@_query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, by a model of the documents that are not held out."""
    docs = _documents(spark, folder)
    held = langid.held_out()
    model = langid.fit(docs.where(~held))
    predict = langid.predictor(docs, model)
    found = docs.select("doc_id", held.alias("held_out"), predict(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@_query
def op10_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    found = extract(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next one's are."""
    found = fingerprints(_documents(spark, folder))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@_query
def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's three best segmentations, and whether the best decodes to the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(_documents(spark, folder), model)
    found = found.withColumn("decoded", pieces.decode(F.col("segmentations")[0]["ids"], model))
    ids = F.transform("segmentations", lambda x: x["ids"])
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        (F.length(ids[0]) / 4).cast("long").alias("n_pieces"),
        F.transform("segmentations", lambda x: F.round(x["score"], 3)).alias("scores"),
        F.transform(ids, lambda x: F.crc32(x)).alias("ids_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 50 words and more that an earlier one holds."""
    found = substring_dedup(_documents(spark, folder))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_substrings"] = r"""
WITH tokens AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS run
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM tokens)
), judged AS (
    SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY run) AS again FROM windows
), covered AS (
    SELECT doc_id, pos FROM judged WHERE again
), gone AS (
    SELECT DISTINCT doc_id, pos + k AS pos FROM covered, range(50) AS r(k)
), kept AS (
    SELECT t.doc_id, t.pos, t.word, g.pos IS NOT NULL AS drop
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM tokens) t
    LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos
)
SELECT d.doc_id, count(k.word) AS n_words, count(*) FILTER (WHERE k.drop) AS n_removed,
       sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.pos) FILTER (WHERE NOT k.drop), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


@_query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's likelihood of a toxic label, by models of the labels that are not held out."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxic.toxicity(_documents(spark, folder), labels.where(~toxic.held_out()))
    return found.select("doc_id", toxic.held_out().alias("held_out"), "score", "predicted")


@_query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))


ORACLES["op12_conversations"] = twins.conversations()


@_query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after five rounds."""
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op13_centroids"] = twins.centroids()


@_query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The packed corpus after all stages."""
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
