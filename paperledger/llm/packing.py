"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import text_of

WINDOW, END = 1024, 0
#: Open windows beyond which documents are cut to close some; bytes of ids and rows that a task holds back before it sends them on.
MAX_OPEN, SEND_BYTES, SEND_ROWS = 512, 1 << 21, 4000

# How the vocabulary spells bytes; printable ones as themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {chr(b): b for b in _PRINTABLE}
# Fixed value: the pieces that byte-level merging never joins.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str) -> Callable[[str], bytes] | None:
    """An encoder by merge ranks, where the file is a plain byte-level one whose ids follow the merges; it gives the same ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, added = spec["model"], spec["added_tokens"]
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and {k: (spec.get("pre_tokenizer") or {}).get(k) for k in cut} == cut
    plain &= not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    if not plain:
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(_SPELLED[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    if merged != sorted(merged) or len(ranks) != len(merged) + 256:
        return None
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()


def _library(path: str) -> Callable[[str], bytes]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def encode(text: str, path: str) -> bytes:
    """The ids of a text, little-endian, 4 bytes each, as the tokenizer of this file gives them; nothing is added."""
    encoder = _ENCODERS.get(path)
    if encoder is None:
        encoder = _ENCODERS[path] = _ranked(path) or _library(path)
    return encoder(text)


class Packer:
    """One stream of documents into windows.

    ``levels[h]`` counts the windows filled to ``h``. A document goes to the
    level at which the sum of the squared counts is smallest afterwards. Full
    windows, and those filled to a power of two, need no padding and don't
    count. Pieces are final when they are placed, so only counts and the
    numbers of open windows are kept.
    """

    def __init__(self, window: int = WINDOW, first: int = 0, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.padded = np.array([h & (h - 1) != 0 for h in range(window + 1)])
        self.padded[window] = False
        self.gap = 0  # positions that padding would fill just now
        self.partial = 0  # windows that would get padding

    def _move(self, level: int, size: int) -> tuple[int, int]:
        if level:
            number = self.open[level].pop()
            self._count(level, -1)
        else:
            number, self.next = self.next, self.next + 1
        if level + size < self.window:
            self.open[level + size].append(number)
            self._count(level + size, 1)
        return number, level

    def _count(self, level: int, by: int) -> None:
        self.levels[level] += by
        if self.padded[level]:
            self.gap += by * (self.window - level)
            self.partial += by

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for a piece of ``size`` at most the window."""
        at = np.concatenate(([0], 1 + np.flatnonzero(self.levels[1 : self.window - size + 1])))
        to = at + size
        change = np.where(self.padded[at], 1 - 2 * self.levels[at], 0) + np.where(self.padded[to], 1 + 2 * self.levels[to], 0)
        return self._move(int(at[len(at) - 1 - np.argmin(change[::-1])]), size)

    def whole(self, size: int) -> Iterator[tuple[int, int, int]]:
        """``length, window, offset`` of a document's pieces: full windows, and a rest placed by the rule."""
        for _ in range(size // self.window):
            yield self.window, *self._move(0, self.window)
        if size % self.window:
            yield size % self.window, *self.place(size % self.window)

    def cut(self, size: int) -> Iterator[tuple[int, int, int]]:
        """The same, but the document is cut to close the fullest windows first."""
        while size and self.partial:
            level = int(np.flatnonzero((self.levels > 0) & self.padded)[-1])
            length = min(size, self.window - level)
            yield length, *self._move(level, length)
            size -= length
        yield from self.whole(size)

    def last(self, size: int) -> Iterator[tuple[int, int, int]]:
        """The same for the last document: its rest is cut at powers of two, which need no padding."""
        while size and self.partial:
            level = int(np.flatnonzero((self.levels > 0) & self.padded)[-1])
            length = min(size, self.window - level)
            yield length, *self._move(level, length)
            size -= length
        while size:
            length = min(self.window, 1 << (size.bit_length() - 1))
            yield length, *self._move(0, length)
            size -= length


def packed(docs: Iterator[tuple[object, np.ndarray]], packer: Packer) -> Iterator[tuple]:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of each piece.

    As many tokens are held back as the open windows lack; when the stream ends
    they are cut to close those windows.
    """
    held, tokens = deque(), 0

    def pieces(doc, parts):
        start = 0
        for length, window, offset in parts:
            yield doc[0], start, length, doc[1][start : start + length].tobytes(), len(doc[1]), window, offset
            start += length

    for doc in docs:
        held.append(doc)
        tokens += len(doc[1])
        while tokens - len(held[0][1]) > packer.gap:
            size = len(held[0][1])
            tokens -= size
            yield from pieces(held.popleft(), packer.cut(size) if packer.partial > packer.max_open else packer.whole(size))
    while held:
        doc = held.popleft()
        yield from pieces(doc, packer.cut(len(doc[1])) if held else packer.last(len(doc[1])))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of each piece; ``ids`` are 4 little-endian bytes each.

    ``tokenizer``: the path of the tokenizer's file. Each partition is one
    stream, so nothing is shuffled, and a lost task packs the same rows into
    the same windows again. A document of at most ``window`` tokens stays
    whole, unless it closes windows at the end of a stream or when more than
    ``max_open`` are open. Null and empty texts are one piece, the end mark.
    Repeated rows are packed each time; null ids are carried along. An empty
    table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(window, TaskContext.get().partitionId() << 40, max_open)
        columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        end = np.array([END], "<u4")

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                    yield doc_id, np.concatenate((np.frombuffer(encode(text, tokenizer), "<u4"), end))

        rows, size = [], 0
        for row in packed(documents(), packer):
            rows.append(row)
            size += len(row[3])
            if size > SEND_BYTES or len(rows) >= SEND_ROWS:
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, schema)
