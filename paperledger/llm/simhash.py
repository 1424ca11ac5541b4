"""SimHash near-dedup by a self-join of binary tries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperledger.llm.common import written
from paperledger.llm.components import components

#: Words of a shingle, bits that may differ, seed of the hash.
SHINGLE, BUDGET, SEED = 3, 2, 42
#: Fingerprints that one top node of the trie should hold, and the deepest level of such nodes.
NODE_ROWS, MAX_TOP_BITS = 4096, 24
#: Node pairs walked at a time; pairs of nodes with no more leaf pairs are compared leaf by leaf.
BLOCK, LEAF_PAIRS = 1 << 16, 16


def simhash(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the shingles' hashes have it set; 0 without a word."""
    words = (data or b"").lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not words:
        return 0
    body, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        spans = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())
        ones += _ones(np.fromiter((digest(body[a:b], SEED) for a, b in spans), np.uint64))
    return _print(ones, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _print(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already."""
    return _print(sum((_ones(hashes[k : k + (1 << 16)]) for k in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64)), len(hashes))


@F.pandas_udf(T.LongType())
def _simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (a signed 64-bit number) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), _simhash_column(F.col(text_col).cast("binary")).alias("fingerprint"))


def trie_join(left: np.ndarray, right: np.ndarray, top: int, budget: int, same: bool, width: int = 64, head: int | None = None):
    """Blocks of index pairs whose fingerprints differ in at most ``budget`` bits.

    ``left`` and ``right`` are sorted, each below one node ``top`` bits deep; a
    node is a range of the array. Pairs of nodes go down together: children are
    paired, a pair of unlike children has one more error, and a pair beyond
    the budget or with an empty side ends. ``same``: both are one trie, so a
    pair of children is walked in one order only. The stack holds blocks of
    limited size, so memory doesn't grow with the number of pairs. ``head`` is
    the budget of the first ``width`` bits, where it is a smaller one.
    """
    head = budget if head is None else head
    if not (len(left) and len(right)):
        return
    errors = int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(64 - top))) if top else 0
    if errors > (head if top <= width else budget):
        return
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def below(depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in zeros:
            bit = np.uint64(63 - depth)
            zeros[depth] = tuple(np.concatenate(([0], np.cumsum(((x >> bit) & np.uint64(1)) == 0))) for x in (left, right))
        return zeros[depth]

    stack = [(top, np.array([[0, len(left), 0, len(right), errors]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > BLOCK:
            stack += [(depth, pairs[BLOCK:]), (depth, pairs[:BLOCK])]
            continue
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (sizes <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            yield _leaf_pairs(left, right, pairs[small], sizes[small], budget, same)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        zl, zr = below(depth)
        a, b, c, d, e = pairs.T
        m, n = a + zl[b] - zl[a], c + zr[d] - zr[c]
        own = (a == c) & (b == d) if same else np.zeros(len(pairs), bool)
        down = np.concatenate([np.stack(x, 1) for x in ((a, m, c, n, e), (m, b, n, d, e), (a, m, n, d, e + 1), tuple(y[~own] for y in (m, b, c, n, e + 1)))])
        stack.append((depth + 1, down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= (head if depth < width else budget))]))


def _leaf_pairs(left, right, pairs, sizes, budget, same):
    which = np.repeat(np.arange(len(pairs)), sizes)
    at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (pairs[:, 3] - pairs[:, 2])[which]
    i, j = pairs[which, 0] + at // wide, pairs[which, 2] + at % wide
    near = np.bitwise_count(left[i] ^ right[j]) <= budget
    if same:
        near &= i < j
    return i[near], j[near]


class Forest:
    """Union-find that keeps only the given links which join two trees."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.parent[i], self.parent[j]  # roots, as the array is flattened after each call
        apart = np.flatnonzero(a != b)
        firsts = apart[np.sort(np.unique(a[apart] * len(self.parent) + b[apart], return_index=True)[1])]
        for x, y, u, v in zip(a[firsts].tolist(), b[firsts].tolist(), i[firsts].tolist(), j[firsts].tolist()):
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.links.append((u, v))
                self.parent[max(x, y)] = min(x, y)
        while (flat := self.parent[self.parent]) is not None and (flat != self.parent).any():
            self.parent = flat


def near_links(prints: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS, blocks: int = 1) -> DataFrame:
    """``u, v``: links between representatives of fingerprints (``fingerprint, rep``, each print once) that join all near ones.

    The top of the trie is spread over tasks: a top node is a prefix so long
    that a node holds about ``node_rows`` prints, and a task walks one pair of
    top nodes whose prefixes differ within the budget. A task returns a
    spanning forest of the links it finds, the nearest of a block first, so at
    most as many as it has prints; each is a near pair itself.

    For a wide budget, the print is cut into ``blocks``, of which one has at
    most ``budget // blocks`` of the errors. There is a trie for each block,
    of the prints turned until that block leads; it takes a pair down the
    block with that smaller budget, and further down with the whole one.
    """
    width, head = 64 // blocks, budget // blocks
    top = min(MAX_TOP_BITS, width, max(0, math.ceil(math.log2(max(1, prints.count()) / node_rows))))
    flips = [0] + [sum(1 << b for b in bits) for n in range(1, min(head, top) + 1) for bits in _choices(top, n)]
    turned = [F.shiftleft("fingerprint", k * width).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - k * width)) if k else F.col("fingerprint") for k in range(blocks)]
    dealt = prints.select("rep", F.posexplode(F.array(*turned)).alias("block", "fingerprint")) if blocks > 1 else prints.withColumn("block", F.lit(0))
    prefix = F.shiftrightunsigned("fingerprint", 64 - top) if top else F.lit(0).cast("long")
    placed = dealt.withColumn("prefix", prefix).withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
    other = F.col("prefix").bitwiseXOR(F.col("flip"))
    low, high = F.least("prefix", other), F.greatest("prefix", other)
    placed = placed.select("fingerprint", "rep", "block", low.alias("low"), high.alias("high"))

    def walk(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(print=rows["fingerprint"].to_numpy(np.int64).view(np.uint64)).sort_values("print")
        prints_, reps = rows["print"].to_numpy(), rows["rep"].to_numpy()
        side = prints_ >> np.uint64(64 - top) if top else np.zeros(len(prints_), np.uint64)
        _, low, high = key
        same = low == high
        li = np.flatnonzero(side == np.uint64(low))
        ri = li if same else np.flatnonzero(side == np.uint64(high))
        forest = Forest(len(rows))
        for i, j in trie_join(prints_[li], prints_[ri], top, budget, same, width, head):
            nearest = np.argsort(np.bitwise_count(prints_[li[i]] ^ prints_[ri[j]]), kind="stable")
            forest.add(li[i[nearest]], ri[j[nearest]])
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": reps[found[:, 0]], "v": reps[found[:, 1]]})

    return placed.groupBy("block", "low", "high").applyInPandas(walk, "u long, v long")


def _choices(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents linked over any number of steps share a component.

    Null texts and texts without a word have fingerprint 0 and are linked like
    any other. Equal fingerprints are one node, so groups of copies cost
    nothing in the join. Repeated rows are returned as often as they come;
    rows with a null id take no part in links and have a null component.
    Empty tables give no row; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("rep")).where("rep IS NOT NULL"))
    roots = components(near_links(nodes, budget, node_rows))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id"))
    joined = prints.join(named, "fingerprint", "left")
    return joined.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a near one with a smaller id stands for. Rows with a null id stay."""
    found = near_components(docs, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
