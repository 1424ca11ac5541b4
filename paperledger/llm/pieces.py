"""Encoding and decoding with a SentencePiece vocabulary: the N best segmentations of a text."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import Remembered, text_of

#: Segmentations that are returned; chunks whose best segmentation a worker remembers.
BEST, MEMORY = 3, 170_000

#: Texts whose segmentations a worker holds at a time.
ROWS = 200

#: No piece goes on behind a blank that follows another character, so texts are sums of such chunks.
_CHUNK = re.compile(" +[^ ]*|[^ ]+")


class Vocabulary:
    """Pieces and scores of a model, with blanks as blanks.

    A character that is no piece is written as its bytes, at the cost of an
    unknown piece: 10 below the lowest score.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, bytes] = {}
        self.texts: list[bytes] = []
        for k in range(model.get_piece_size()):
            piece, text = model.id_to_piece(k), b""
            if model.is_byte(k):
                text = bytes([int(piece[3:5], 16)])
                self.bytes[text[0]] = np.array([k], "<u4").tobytes()
            elif not (model.is_control(k) or model.is_unknown(k)):
                piece = piece.replace("▁", " ")
                self.pieces[piece], text = (k, model.get_score(k)), piece.encode()
            self.texts.append(text)
        # Scores of pieces, and minus infinity for what only starts one.
        self.starts = {piece[:k]: float("-inf") for piece in self.pieces for k in range(1, len(piece))}
        self.starts.update((piece, score) for piece, (_, score) in self.pieces.items())
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((score for _, score in self.pieces.values() if score > -1e8), default=0.0) - 10
        self.ids = {piece: np.array([k], "<u4").tobytes() for piece, (k, _) in self.pieces.items()}

    def fallback(self, character: str) -> bytes:
        return b"".join(self.bytes[x] for x in character.encode())

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        whole = b"".join([texts[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return whole[1:]  # the blank that encoding puts in front


def n_best(chunk: str, words: Vocabulary, n: int) -> list[tuple[float, bytes]]:
    """The ``n`` best segmentations of a chunk with their ids, best first.

    Forward, Viterbi gives the best score from the start to each position.
    Backward from the end, A-star takes that score as its estimate of what is
    left; as the estimate is exact, whole paths come out in order of score.
    """
    size, pieces, longest = len(chunk), words.pieces, words.longest
    edges: list[list[tuple[int, float, bytes]]] = [[] for _ in range(size + 1)]
    forward = [0.0] * (size + 1)
    for j in range(1, size + 1):
        here = edges[j]
        for i in range(max(0, j - longest), j):
            piece = chunk[i:j]
            found = pieces.get(piece)
            if found is not None:
                here.append((i, found[1], words.ids[piece]))
        if chunk[j - 1] not in pieces:
            here.append((j - 1, words.unknown, words.fallback(chunk[j - 1])))
        forward[j] = max(forward[i] + score for i, score, _ in here)
    out: list[tuple[float, bytes]] = []
    ticket = 0  # of equal scores the path nearest to its end goes on, so that ties are not all walked
    queue: list = [(-forward[size], size, ticket, 0.0, None)]
    while queue and len(out) < n:
        total, at, _, behind, path = heapq.heappop(queue)
        if not at:
            ids = []
            while path:
                piece, path = path
                ids.append(piece)
            out.append((-total, b"".join(ids)))
            continue
        for i, score, piece in edges[at]:
            ticket += 1
            heapq.heappush(queue, (-(forward[i] + score + behind), i, ticket, score + behind, (piece, path)))
    return out


def best_and_loss(chunk: str, words: Vocabulary) -> tuple[bytes, float, float]:
    """Ids and score of the best segmentation of a chunk, and what the second best loses: Viterbi with two scores."""
    size, get, none = len(chunk), words.starts.get, float("-inf")
    first, second = [0.0] + [none] * size, [none] * (size + 1)
    back = [0] * (size + 1)
    for i in range(size):
        one, two = first[i], second[i]
        for j in range(i + 1, size + 1):
            score = get(chunk[i:j])
            if score is None:  # no piece goes on like this
                if j > i + 1:
                    break
                score = words.unknown
            elif score == none:  # only the start of pieces
                if j > i + 1:
                    continue
                score = words.unknown
            total = one + score
            best = first[j]
            if total > best:
                other = two + score
                first[j], second[j], back[j] = total, best if best > other else other, i
            elif total > second[j]:
                second[j] = total
    ids, j = [], size
    while j:
        piece = chunk[back[j] : j]
        ids.append(words.ids.get(piece) or words.fallback(piece))
        j = back[j]
    return b"".join(ids[::-1]), first[size], first[size] - second[size]


class Encoder:
    """Texts to their segmentations; of chunks it remembers the best ids, their score and the loss of the second best."""

    def __init__(self, words: Vocabulary, n: int):
        self.words, self.n = words, n
        self.chunks = Remembered(lambda chunk: best_and_loss(chunk, words), MEMORY)
        self.close = Remembered(lambda chunk: n_best(chunk, words, n), MEMORY // 20)

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a whole text.

        Only the n - 1 chunks with the smallest losses can differ from their
        best in one of them: each other change is worse than n - 1 of these.
        So only these are searched for their ``n`` best.
        """
        if not text:
            return [(0.0, b"")]
        parts = _CHUNK.findall(" " + text)
        chunks = list(map(self.chunks.__getitem__, parts))
        score = sum([entry[1] for entry in chunks])
        losses = np.array([entry[2] for entry in chunks])
        few = np.sort(np.argsort(losses, kind="stable")[: self.n - 1])
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for k in few.tolist():
            found = self.close[parts[k]]
            first = found[0][0]
            ways = heapq.nsmallest(self.n, ((loss + first - s, (*choice, (k, ids))) for loss, choice in ways for s, ids in found), key=lambda way: way[0])
        best = [entry[0] for entry in chunks]
        whole = b"".join(best)
        starts = {k: sum(map(len, best[:k])) for k in few.tolist()}
        out = []
        for loss, choice in ways:
            ids = whole
            for k, other in reversed(choice):  # from behind, so that the places before stay where they are
                ids = ids[: starts[k]] + other + ids[starts[k] + len(best[k]) :]
            out.append((score - loss, ids))
        return out


def encode(docs: DataFrame, model: str, best: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, segmentations``: up to ``best`` of them, best first, each ``score, ids`` (4 little-endian bytes an id).

    ``model``: the path of the vocabulary. Nothing is shuffled. Null and empty
    texts have one segmentation without pieces and score 0. Of equal scores
    either may come first, but the same always. Repeated rows are encoded each
    time, null ids carried along. Empty tables give no row; other columns are
    ignored.
    """

    @F.pandas_udf("array<struct<score: double, ids: binary>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(model), best)
        for batch in batches:
            for k in range(0, len(batch), ROWS):  # several ids for each character: small parts keep memory low
                yield pd.Series([[{"score": score, "ids": ids} for score, ids in encoder.encode(text)] for text in batch.iloc[k : k + ROWS]])

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), run(text).alias("segmentations"))


def decoder(model: str):
    """A function from a column of ids to its text: the inverse of every segmentation."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Vocabulary(model)
        for batch in batches:
            yield pd.Series([None if ids is None else words.decode(ids) for ids in batch], dtype=object)

    return run


def decode(ids: Column, model: str) -> Column:
    return decoder(model)(ids)
