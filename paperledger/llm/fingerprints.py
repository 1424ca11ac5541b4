"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import bucket_of, text_of

#: Words of a term, samples of a fingerprint.
SHINGLE, SAMPLES = 5, 64
#: Rows that a range of ids should hold, and the most ranges (the driver keeps two numbers for each).
RANGE_ROWS, MAX_RANGES = 2048, 10_000
#: Terms that are sampled at a time.
BLOCK = 2048

_SALTS = np.random.default_rng(20).integers(1, 1 << 32, (6, SAMPLES), np.uint32)
_FACTORS = np.random.default_rng(21).integers(1, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def terms(data: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles (A-Z in lower case) and how often each occurs; of fewer words, the one sequence."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(word) for word in words], np.uint64)
    width = min(shingle, len(hashes))
    mixed = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        mixed += hashes[k : k + len(mixed)] * _FACTORS[k]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * _FACTORS[15], return_counts=True)


def _mixed(low: np.ndarray, high: np.ndarray, salt: np.ndarray) -> np.ndarray:
    x = (low ^ salt) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x += high
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(16)
    return x


def _uniform(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    x = _mixed(low, high, _SALTS[k])
    x >>= np.uint32(8)
    u = x.astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-24)
    return u


def _gamma(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    x = _uniform(low, high, k)
    x *= _uniform(low, high, k + 1)
    np.log(x, out=x)
    return np.negative(x, out=x)


def draws(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and rank of terms in each sample; the arrays have a last axis of 1 or of the samples.

    With r and c of a gamma(2, 1) and b of a uniform distribution, all drawn
    from the term's hash, the weight w is rounded down to a level t of a grid
    of step r and offset b; the term's rank is ln c - r (t - b) - r. The pair of
    term and level that ranks least is the same in two documents with the
    chance of their generalised Jaccard similarity.
    """
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    r, c, b = _gamma(low, high, 0), _gamma(low, high, 2), _uniform(low, high, 4)
    level = np.floor(np.log(weights.astype(np.float32)) / r + b) if (weights != 1).any() else np.zeros(1, np.float32)  # b < 1
    b -= level
    b -= np.float32(1)
    b *= r
    b += np.log(c, out=c)
    return level, b


def names(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """32-bit names of terms with their levels, one for each sample: ``hashes`` has a column for each."""
    level = np.broadcast_to(draws(hashes, weights)[0], hashes.shape)
    name = _mixed(hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32), _SALTS[5])
    return name ^ (level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))


def sample(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The samples of one set of weighted terms."""
    won = draws(hashes[:, None], weights[:, None])[1].argmin(axis=0)
    return names(hashes[won][None], weights[won][None])[0]


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row of ``SAMPLES`` 32-bit names for each text; zeros for a text without a word."""
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    found = [terms(text) for text in texts]
    sizes = np.array([len(hashes) for hashes, _ in found], np.int64)
    if not sizes.sum():
        return out
    hashes, weights = (np.concatenate(x) for x in zip(*found))
    # A term of several texts is ranked once; those of weight 1, nearly all, come together and are cheaper.
    _, first, inverse = np.unique(hashes ^ (weights.astype(np.uint64) * _FACTORS[14]), return_index=True, return_inverse=True)
    order = np.argsort(weights[first] != 1, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, inverse = first[order], place[inverse]
    table = np.empty((len(first), SAMPLES), np.float32)
    for k in range(0, len(first), BLOCK):
        block = first[k : k + BLOCK]
        table[k : k + BLOCK] = draws(hashes[block, None], weights[block, None])[1]
    won, at = np.zeros((len(texts), SAMPLES), np.int64), 0
    for row, size in enumerate(sizes.tolist()):
        if size:
            own = inverse[at : at + size]
            # Of equal ranks, the term that comes first in the text's own order of hashes.
            won[row] = at + table[own].argmin(axis=0)
            at += size
    some = sizes > 0
    out[some] = names(hashes[won[some]], weights[won[some]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def _groups(rows: list, limit: int = 1 << 19) -> Iterator[list]:
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[2])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    The next document is the one with the next smaller id; after the smallest
    comes the largest. Ids are cut into ranges of about ``range_rows``, and the
    largest row of each range is sent to the following range as well, so that
    each text is shuffled once and no task sees more than its ranges, as a
    sorted stream.

    Null and empty texts, and those of white space, have the fingerprint of no
    terms; two of them are alike. Null ids come before all others; rows that
    share an id are ordered by a hash of their text. A single row is next to
    itself. Empty tables give no row; other columns are ignored.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("at"))
    n = min(MAX_RANGES, math.ceil(max(1, ids.count()) / range_rows))
    cuts = ids.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 100 * n).alias("cuts")).head()["cuts"] if n > 1 else None
    bounds = sorted(set(cuts or []))
    last = {row["range"]: row["last"] for row in ids.groupBy(bucket_of(F.col("at"), bounds).alias("range")).agg(F.max("at").alias("last")).collect()}
    ranges = sorted(last)
    after = dict(zip(ranges, ranges[1:] + ranges[:1]))
    n = len(bounds) + 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("at"), text_of(text_col).alias("text"))
    rows = rows.withColumn("range", bucket_of(F.col("at"), bounds))
    ends = spark.createDataFrame([(k, last[k], after[k]) for k in ranges], "range int, last long, after int") if ranges else None
    if ends is None:
        placed = rows.withColumns({"sent": F.lit(False)})
    else:
        # Two numbers for each of at most MAX_RANGES ranges: small enough to send to every task.
        placed = rows.join(F.broadcast(ends), "range")
        own = F.struct(F.col("range"), F.lit(False).alias("sent"))
        copy = F.struct(F.col("after").alias("range"), F.lit(True).alias("sent"))
        placed = placed.select("doc_id", "at", "text", F.explode(F.when(F.col("at") == F.col("last"), F.array(own, copy)).otherwise(F.array(own))).alias("to"))
        placed = placed.select("doc_id", "at", "text", "to.range", "to.sent")
    dealt = placed.repartitionById(n, F.col("range")) if n > 1 else placed.coalesce(1)
    dealt = dealt.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("range", F.desc("sent"), "at", "tie").select("doc_id", "range", "sent", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, signature = "", None  # of the row before; the first of a range is a sent one
        for batch in batches:
            rows = zip(batch["doc_id"].astype("Int64"), zip(batch["range"], batch["sent"]), batch["text"])
            for group in _groups(list(rows)):
                before = [text]
                for _, _, own in group:
                    before.append(own)
                edited = [own if sent else own[: len(own) - len(own) // 2] + old[: len(own) // 2] for (_, (_, sent), own), old in zip(group, before)]
                signed = signatures([x[2].encode() for x in group] + [x.encode() for x in edited])
                out = []
                for k, (doc_id, (_, sent), own) in enumerate(group):
                    if not sent:
                        other = signed[len(group) + k]
                        out.append((doc_id, len(own), edited[k], signed[k].astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(signed[k], other), likeness(signed[k], signature)))
                    text, signature = own, signed[k]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
