"""Near copies by exact Jaccard of word shingles, with candidates from tries of SimHash prints, then from bands of min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperledger.llm.common import stored
from paperledger.llm.components import components
from paperledger.llm.simhash import near_links, print_of

#: Words of a shingle, likeness from which two texts are near copies.
SHINGLE, LEAST = 5, 0.8
#: Bits that prints of near copies may differ in and still meet in the tries, blocks of a print (two errors in one of them), prints of a top node.
BUDGET, PRINT_BLOCKS, NODE_ROWS = 11, 4, 1 << 15
#: Two texts that the tries left apart meet if all rows of one band agree: at a likeness of 0.8 all bands miss with a chance of 3 in a million, above it with less.
BANDS, ROWS = 24, 4
#: Shingles that are hashed by all functions at a time.
BLOCK = 1 << 14

_FACTORS = np.random.default_rng(6).integers(1, 1 << 62, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()  # of bytes: A-Z only, and the ASCII white space


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """The different hashes of all runs of ``n`` words, ascending; of all words if there are fewer, none without a word."""
    if not words:
        return np.zeros(0, np.uint64)
    body, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.unique(np.fromiter((digest(body[a:b]) for a, b in spans), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none without a shingle."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[None, k : k + BLOCK] ^ _FACTORS[0]) * _FACTORS[1]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard of two sets of ascending hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@F.pandas_udf(T.BinaryType())
def _shingle_column(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(words_of(x)).tobytes() for x in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _numbers(sets: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int64) for x in sets], dtype=object)


def _near(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``u, v`` whose shingles (``node, set``) are near."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) >= least for x, y in zip(a, b)], dtype=bool)

    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(near("a", "b")).select("u", "v").distinct()


def _by_rarest(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs ``u, v`` of different ``root`` among the nodes of ``sets`` that can be near; none that is near is missing.

    Sets of ``n`` and ``m`` members that are near share at least ``both`` =
    ``least / (1 + least) * (n + m)``, so they share one of the ``n - both + 1``
    and ``m - both + 1`` that are rarest among all ``sets``. What a whole
    family shares is common, so texts of a family that differ too much seldom
    meet. Of a shingle's nodes, those of its most frequent root are paired
    with the others only.
    """
    one = F.xxhash64("set").alias("tag")  # rows that share an id are sets of their own
    held = sets.select("node", one, F.explode(_numbers("set")).alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    ranked = held.join(counts, "shingle").groupBy("node", "tag").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("ranked")).withColumn("n", F.size("ranked"))
    spare = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1  # for the smallest partner
    rare = ranked.select("node", "n", F.posexplode(F.slice("ranked", F.lit(1), spare.cast("int"))).alias("at", "one")).where("one.c > 1")
    placed = stored(rare.select("node", "n", "at", F.col("one.shingle").alias("shingle")).join(roots, "node"))
    usual = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle")
    usual = usual.agg(F.max_by("root", F.struct("k", "root")).alias("usual"), F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle", "usual")
    right = placed.select("shingle", F.col("node").alias("v"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("top"))
    both = F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-6)
    meet = (F.col("root") != F.col("top")) & (F.col("at") <= F.col("n") - both) & (F.col("to") <= F.col("m") - both)
    met = placed.join(usual, "shingle").where("root <> usual").join(right, "shingle").where(meet)
    return met.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def by_tries(nodes: DataFrame, budget: int = BUDGET, blocks: int = PRINT_BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Pairs ``u, v`` that join all ``nodes`` (``rep, print``) whose prints differ in at most ``budget`` bits: a self-join of tries as in ``simhash``."""
    prints = stored(nodes.groupBy(F.col("print").alias("fingerprint")).agg(F.min("rep").alias("rep")))
    equal = nodes.join(prints, nodes["print"] == prints["fingerprint"]).where(nodes["rep"] > prints["rep"]).select(nodes["rep"].alias("u"), prints["rep"].alias("v"))
    near = near_links(prints, budget, node_rows, blocks).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return equal.unionByName(near).distinct()


def near_roots(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, root`` of each document of ``doc_id, text`` that near links, over any number of steps, join to a smaller one, ``root`` the smallest.

    Texts of equal words are one node. Nodes meet by their SimHash prints (of
    the different shingles) in tries, which return a spanning forest; each
    link is checked by exact Jaccard. What a budget of bits or a forest
    can't reach follows exactly: nodes of a band's bucket that are not joined
    yet are linked to its smallest member, and those of buckets that still
    hold several components meet by their rarest shingles, which misses no
    near pair of them.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                hashes = shingles(words)
                rows.append((doc_id, xxhash.xxh128_digest(b" ".join(words)), np.uint64(print_of(hashes)).astype(np.int64), bands(hashes)))
            yield pd.DataFrame(rows, columns=["doc_id", "same", "print", "bands"])

    signed = stored(docs.mapInPandas(sign, "doc_id long, same binary, print long, bands array<long>"))
    # Written, so that the join below reads two plain shuffles, of which a skewed part (one text in a third of all rows) can be split.
    nodes = stored(signed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("print").alias("print"), F.first("bands").alias("bands")))
    equal = signed.select("doc_id", "same").join(nodes.select("same", "rep"), "same").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    placed = nodes.select("rep", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("bucket", "first")
    members = stored(placed.join(crowded, "bucket"))

    tried = stored(by_tries(nodes.select("rep", "print")))
    wanted = members.select(F.col("rep").alias("node")).unionByName(tried.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = stored(docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", _shingle_column("text").alias("set")).distinct())

    links = stored(equal.unionByName(_near(sets, tried, least)))
    for rarest in (False, True):
        roots = stored(components(links))
        label = lambda frame, by, name: frame.join(roots.select(F.col("node").alias(by), F.col("root").alias(name)), by, "left").withColumn(name, F.coalesce(name, by))  # noqa: B023, E731
        named = stored(label(label(members, "rep", "root"), "first", "top"))
        others = named.where("root <> top")
        if others.isEmpty():
            return roots.select(F.col("node").alias("doc_id"), "root")
        if rarest:
            apart = named.join(others.select("bucket").distinct(), "bucket", "left_semi").select(F.col("rep").alias("node"), "root").distinct()
            pairs = _by_rarest(sets.join(apart.select("node"), "node", "left_semi"), apart, least)
        else:
            pairs = others.select(F.col("rep").alias("u"), F.col("first").alias("v")).distinct()
        links = stored(links.unionByName(_near(sets, stored(pairs), least)))
    roots = components(links)
    return roots.select(F.col("node").alias("doc_id"), "root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that a near one with a smaller id stands for.

    Null texts and texts without a word are copies of each other. Rows with a
    null id stay and take no part; rows that share an id go or stay together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id IS NOT NULL")
    gone = near_roots(rows, least).where("doc_id <> root").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
