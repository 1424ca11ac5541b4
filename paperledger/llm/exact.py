"""Exact dedup by progressive refinement: length, then hash of the prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import bitmap, in_bitmap, text_of, written

#: Characters whose hash is the second level.
PREFIX = 128
#: Bits of the map of surviving groups: 1 MB, whatever the size of the corpus.
MAP_BITS = 1 << 23


def normalised(text: Column | str) -> Column:
    """The text with each run of white space as one blank; single blanks are left alone, which is the usual case."""
    return F.regexp_replace(text_of(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, map_bits: int = MAP_BITS, digests: bool = False) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Level 1 and 2 count documents by (length, prefix hash) of the normalised
    text, in one narrow aggregation; a length that is alone is alone at level 2
    as well. Level 3 hashes the whole text, but only of documents whose level-2
    group has two members or more. Which groups those are is handed to the scan
    as a bitmap of fixed size, so no text is shuffled; two groups in one slot
    cost a needless hash, never a wrong result. Only hashes meet in the joins:
    a group with a third of all rows is a skewed join that AQE splits.

    ``digests``: fill ``text_sha256`` of every document, not of survivors only.

    Null and empty texts are equal to each other. Repeated rows count one by
    one in ``group_size``; rows that share the smallest id are all kept. Null
    ids never win against others; a group of null ids keeps all of them. An
    empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("body"))
    levels = rows.select("doc_id", "body", F.length("body").alias("size"), F.xxhash64(F.substring("body", 1, prefix)).alias("head"))
    shared = levels.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = F.pmod(F.xxhash64("size", "head"), F.lit(map_bits))
    survivors = bitmap(shared.select(slot.alias("slot")), map_bits)

    placed = levels.select("doc_id", "body", "size", slot.alias("slot"), survivors.alias("map"))
    survives = in_bitmap("slot", "map")
    digest = F.sha2("body", 256)
    hashed = placed.select("doc_id", "size", survives.alias("survives"), (digest if digests else F.when(survives, digest)).alias("text_sha256"))
    hashed = written(hashed)

    whole = hashed.where("survives").groupBy("size", "text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # A row that stands alone gets a key of its own: nulls would all meet in one task.
    key = F.when(F.col("survives"), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    joined = hashed.withColumn("key", key).join(whole.select(F.col("text_sha256").alias("key"), "keep_id", "group_size"), "key", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
