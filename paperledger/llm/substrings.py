"""Substring dedup by prefix-partitioned suffix trees over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import bitmap, in_bitmap, text_of

#: Words of a repeat, words of the prefix that splits the suffixes.
WINDOW, PREFIX = 50, 8
#: Bits of the map of shared prefixes (2 MB, whatever the corpus) and words that one subtree is built over.
MAP_BITS, TREE_WORDS = 1 << 24, 1 << 20
#: Bytes kept of a word's hash.
WORD_BYTES = 6

_FACTORS = np.random.default_rng(4).integers(1, 1 << 62, PREFIX + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(word) for word in data.split()], np.uint64)


def anchors(words: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that stand for all windows: prefix hash, position, first and last window of each.

    A window's suffix starts where its ``prefix`` words hash lowest, so equal
    windows have equal suffixes at equal places, and about one position in
    twenty starts a suffix.
    """
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    mixed = np.zeros(len(words) - prefix + 1, np.uint64)
    for k in range(prefix):
        mixed += words[k : k + len(mixed)] * _FACTORS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _FACTORS[prefix]
    mixed ^= mixed >> np.uint64(29)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(mixed, window - prefix + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return mixed[at[first]], at[first], first, last


def subtree(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, the number of the tree node at ``depth`` words that it hangs below.

    Suffixes are named by their first 1, 2, 4, ... words, each name from two of
    the step before, which sorts them; suffixes with one name at ``depth`` are
    the leaves below one node, and a node with several is a repeat of at least
    ``depth`` words. What repeats for longer is several such windows in a row.
    """
    names, length = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while length * 2 <= depth:
        pairs = names[:-length] * (names.max() + 1) + names[length:]
        names, length = np.unique(pairs, return_inverse=True)[1].astype(np.int64), length * 2
    pairs = names[starts] * (names.max() + 1) + names[starts + depth - length]
    return np.unique(pairs, return_inverse=True)[1]


class _Seen:
    """Windows of a prefix too frequent for one subtree: the label of each node and its smallest document."""

    def __init__(self):
        self.labels, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def least(self, labels: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document of each label, among those seen and these, which are now seen too."""
        every, owners = np.concatenate((self.labels, labels)), np.concatenate((self.docs, docs))
        self.labels, inverse = np.unique(every, return_inverse=True)
        self.docs = np.full(len(self.labels), np.iinfo(np.int64).max)
        np.minimum.at(self.docs, inverse, owners)
        return self.docs[inverse[len(every) - len(labels) :]]


def _labels(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(depth):
        out = (out ^ words[starts + k]) * _FACTORS[k % len(_FACTORS)]
        out ^= out >> np.uint64(32)
    return out


def _repeats(group: list[tuple], window: int, seen: _Seen | None) -> list[tuple]:
    """``doc, tag, first, end`` of the words to remove, from segments of one or more whole prefix groups."""
    words = np.concatenate([x[3] for x in group])
    sizes = np.array([len(x[3]) for x in group])
    offsets = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    which = np.repeat(np.arange(len(group)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[which] + inner
    docs = np.array([x[0] for x in group], np.int64)[which]
    if seen is None:
        nodes = subtree(words, starts, window)
        least = np.full(nodes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, nodes, docs)
        gone = least[nodes] < docs
    else:
        gone = seen.least(_labels(words, starts, window), docs) < docs
    hits = np.flatnonzero(gone)
    if not len(hits):
        return []
    # Windows in a row are one range.
    breaks = np.flatnonzero((np.diff(hits) > 1) | (np.diff(which[hits]) > 0))
    out = []
    for a, b in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(hits) - 1]))):
        doc, tag, first, _ = group[which[hits[a]]]
        out.append((doc, tag, int(first + inner[hits[a]]), int(first + inner[hits[b]] + window)))
    return out


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, map_bits: int = MAP_BITS, tree_words: int = TREE_WORDS) -> DataFrame:
    """``doc_id, tag, first, end``: word ranges of ``doc_id, tag, text`` that a smaller document holds as well.

    Pass 1 counts prefixes; those of one document only can't start a repeat and
    are left out of pass 2 by a bitmap of fixed size (two prefixes in one slot
    cost work, never a result). Pass 2 ships each remaining suffix with the
    words of its windows to the task of its prefix, where subtrees are built
    over as many prefix groups as ``tree_words`` allow. A prefix more frequent
    than that is told apart by the whole window, its longest prefix: the task
    then keeps one label and document for each different window.
    """

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(anchors(word_hashes(text), window, prefix)[0]) for text in batch["text"]]
            ids = np.repeat(batch["doc_id"].to_numpy(), [len(x) for x in found])
            yield pd.DataFrame({"prefix": np.concatenate(found).view(np.int64) if found else [], "doc_id": ids})

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    shared = texts.mapInPandas(prefixes, "prefix long, doc_id long").groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    slot = F.pmod(F.xxhash64("prefix"), F.lit(map_bits))
    known = bitmap(shared.select(slot.alias("slot")), map_bits)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, tag, text in zip(batch["doc_id"], batch["tag"], batch["text"]):
                words = word_hashes(text)
                keys, _, first, last = anchors(words, window, prefix)
                raw = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
                for column, values in zip(columns, ([doc_id] * len(keys), [tag] * len(keys), keys.view(np.int64), first, [raw[a : b + window].tobytes() for a, b in zip(first, last)])):
                    column.extend(values)
            yield pd.DataFrame(dict(zip(("doc_id", "tag", "prefix", "first", "words"), columns)))

    everything = docs.select("doc_id", "tag", F.col("text").cast("binary").alias("text")).mapInPandas(suffixes, "doc_id long, tag long, prefix long, first long, words binary")
    alive = everything.withColumns({"slot": slot, "map": known}).where(in_bitmap("slot", "map")).drop("slot", "map")
    dealt = alive.repartition("prefix").sortWithinPartitions("prefix", "doc_id", "tag", "first")

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "tag", "first", "end"]
        held: list[tuple] = []  # whole groups
        group: list[tuple] = []  # the current group
        size, group_size, current, seen = 0, 0, None, None

        def close():
            """The current group is whole: keep it if it can hold a repeat."""
            nonlocal held, group, size, group_size, seen
            out = []
            if seen is not None:
                out = _repeats(group, window, seen) if group else []
            elif len(group) > 1:
                held, size = held + group, size + group_size
                if size > tree_words:
                    out, held, size = _repeats(held, window, None), [], 0
            group, group_size, seen = [], 0, None
            return out

        for batch in batches:
            out = []
            for doc_id, tag, key, first, raw in zip(batch["doc_id"], batch["tag"], batch["prefix"], batch["first"], batch["words"]):
                if key != current:
                    out += close()
                    current = key
                words = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
                words[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
                group.append((doc_id, tag, first, words.view(np.uint64)[:, 0]))
                group_size += len(words)
                if group_size > tree_words:
                    seen = seen or _Seen()
                    out += _repeats(group, window, seen)
                    group, group_size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)
        out = close()
        if held:
            out += _repeats(held, window, None)
        if out:
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(trees, "doc_id long, tag long, first long, end long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, map_bits: int = MAP_BITS, tree_words: int = TREE_WORDS) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: each text's remaining words joined by one blank.

    A word goes if a run of ``window`` words over it also occurs in a document
    with a smaller id; runs are judged on the input. Repeats within a document
    stay. Texts of fewer words lose none; null texts have no words. Rows that
    share an id count as one document; a null id is the smallest of all. Empty
    tables give no row; other columns are ignored.
    """
    earliest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(earliest)).alias("doc_id"), text_of(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    found = repeats(rows, window, prefix, map_bits, tree_words)
    cuts = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "end")).alias("cuts"))

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, ranges):
            words = text.split()
            gone = np.zeros(len(words), bool)
            for span in spans if spans is not None else ():
                gone[span["first"] : span["end"]] = True
            kept = [word for word, drop in zip(words, gone.tolist()) if not drop] if gone.any() else words
            out.append((b" ".join(kept).decode("utf-8", "replace"), len(words), len(words) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    joined = rows.join(cuts, ["doc_id", "tag"], "left").select("doc_id", cut(F.col("text").cast("binary"), "cuts").alias("cut"))
    return joined.select(F.when(F.col("doc_id") != earliest, F.col("doc_id")).alias("doc_id"), "cut.text", "cut.n_words", "cut.n_removed")
