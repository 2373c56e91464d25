"""Greedy word-piece lengths by a longest-match automaton.

The vocabulary is a trie of bytes. Every node has a failure link: the node reached after the
longest pieces have been popped off the front of what the node spells, and the number of pieces
popped on the way. A word is read once, left to right; where the trie has no step, the link is
followed and its count added. No piece is ever built.

All distinct words of a slice of texts advance together, one byte per step. A word starts with the
word mark, as pieces that start a word do; a word that cannot be cut into pieces counts as one
unknown token.

Cases: a null text counts as empty; an empty text has zeros. Blanks, tabs and line ends divide
words. With no vocabulary every word is unknown. Repeated rows are counted alike. Columns of the
input named like a result column are replaced by it.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecall.llm.shared import free_prefix
from duecall.llm.text import flat, slices, span_hashes, words

MARK = "▁"


def pieces_of(model_file: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model: no control, unknown, unused or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        model.id_to_piece(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Automaton:
    def __init__(self, pieces: Sequence[str]):
        steps: list[dict[int, int]] = [{}]
        ends = {0: False}
        number = {}
        for k, piece in enumerate(pieces):
            node = 0
            for byte in piece.encode():
                if byte not in steps[node]:
                    steps.append({})
                    ends[len(steps) - 1] = False
                    steps[node][byte] = len(steps) - 1
                node = steps[node][byte]
            ends[node] = node > 0
            number[node] = k
        used = sorted({byte for step in steps for byte in step})
        # column 0 stands for all bytes that no piece has
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        self.go = np.full((len(steps), len(used) + 1), -1, np.int32)
        self.fail = np.full(len(steps), -1, np.int32)
        self.popped = np.zeros(len(steps), np.int32)
        self.piece = np.full(len(steps), -1, np.int32)  # which piece a node spells
        self.piece[list(number)] = list(number.values())
        self.piece[0] = -1
        # parents have smaller depth than their children, so links are ready when needed
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in steps[node].items():
                    self.go[node, self.column[byte]] = child
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    count, link = int(self.popped[node]), int(self.fail[node])
                    while link >= 0 and byte not in steps[link]:
                        count += int(self.popped[link])
                        link = int(self.fail[link])
                    if link >= 0:
                        self.fail[child], self.popped[child] = steps[link][byte], count
            level = below
        self.first = 0
        for byte in MARK.encode():
            self.first = steps[self.first].get(byte, -1) if self.first >= 0 else -1

    def lengths(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces per word; 0 where the word cannot be cut into pieces."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        node = np.full(len(start), self.first, np.int32)
        count = np.zeros(len(start), np.int64)
        active = len(start) if self.first >= 0 else 0
        step = 0
        while active:
            active = int(np.searchsorted(-size, -step, "left"))
            lanes = np.flatnonzero(node[:active] >= 0)
            if not len(lanes):
                break
            column = self.column[data[start[lanes] + step]]
            while len(lanes):
                onward = self.go[node[lanes], column]
                stuck = onward < 0
                node[lanes[~stuck]] = onward[~stuck]
                lanes, column = lanes[stuck], column[stuck]
                count[lanes] += self.popped[node[lanes]]
                node[lanes] = self.fail[node[lanes]]
                alive = node[lanes] >= 0
                lanes, column = lanes[alive], column[alive]
            step += 1
        lanes = np.flatnonzero(node > 0)
        while len(lanes):
            count[lanes] += self.popped[node[lanes]]
            node[lanes] = self.fail[node[lanes]]
            lanes = lanes[node[lanes] > 0]
        count[node < 0] = 0
        out = np.empty_like(count)
        out[order] = count
        return out


_built: dict[int, Automaton] = {}


def _automaton(pieces: list[str]) -> Automaton:
    """Built once per Python worker."""
    key = hash(tuple(pieces))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def count_batch(column: pa.Array, automaton: Automaton) -> np.ndarray:
    """Rows of words, pieces (an unknown word counts 1) and unknown words."""
    out = np.zeros((len(column), 3), np.int64)
    for lo, hi in slices(column):
        data, offsets = flat(column.slice(lo, hi - lo))
        start, end, row = words(data, offsets)
        if not len(start):
            continue
        _, first, back = np.unique(
            span_hashes(data, start, end), return_index=True, return_inverse=True
        )
        n = automaton.lengths(data, start[first], end[first])[back]
        for k, weight in enumerate((None, np.maximum(n, 1), n == 0)):
            out[lo:hi, k] = np.bincount(row, weight, hi - lo)
    return out


def count_tokens(docs: DataFrame, pieces: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_pieces`` and ``n_unknown``."""
    names = ["n_words", "n_pieces", "n_unknown"]
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary, a fixed input

    @F.arrow_udf("struct<n_words: bigint, n_pieces: bigint, n_unknown: bigint>")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(held.value)
        for column in columns:
            found = count_batch(column, automaton)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found = f"{free_prefix(docs)}n"
    return docs.withColumn(found, count(F.col(f"`{text}`"))).select(
        *kept, *[f"{found}.{name}" for name in names]
    )
