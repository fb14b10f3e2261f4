"""Token counts by a linear longest-match automaton (Song, Salcianu, Song, Dopson and Zhou 2021).

The vocabulary is a trie; a node that cannot be extended fails over to the node of what is left
after the longest matches are cut off, and the number of pieces cut off is stored with the link. A
word is read once, byte by byte, adding those numbers; no piece is built. Words are counted once
per task as long as they stay in its memory.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000


class Automaton:
    """Greedy longest-match lengths of words over pieces that start a word and pieces that continue one."""

    def __init__(self, starts: list[bytes], rest: list[bytes]):
        # node 0 begins a word, node 1 begins the rest of one
        self.next: list[dict[int, int]] = [{}, {}]
        is_piece: list[bool] = [False, False]
        for root, pieces in ((0, starts), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.next[node].get(c)
                    if to is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        is_piece.append(False)
                    node = to
                is_piece[node] = is_piece[node] or bool(piece)
        #: Where to go on when a node has no next node, and how many pieces that cuts off; -1: no cut matches.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z != -1 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def pieces(self, word: bytes) -> int:
        """Pieces of a word; -1 where no sequence of longest matches covers it."""
        node, n = 0, 0
        for c in word:
            while c not in self.next[node]:
                n += self.popped[node]
                node = self.fail[node]
                if node == -1:
                    return -1
            node = self.next[node][c]
        while node not in (0, 1):  # what is still open
            n += self.popped[node]
            node = self.fail[node]
            if node == -1:
                return -1
        return n


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a space in front start a word, those without continue one."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    table = byte_table()
    raw = [bytes(table[c] for c in piece) for piece in model["vocab"] if all(c in table for c in piece)]
    starts = [p[1:] for p in raw if p[:1] == b" " and len(p) > 1]
    rest = [p for p in raw if p[:1] != b" "]
    # any byte can start a word, so every word has a cover
    return starts + [p for p in rest if len(p) == 1], rest


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_words, n_tokens, n_unknown.

    n_tokens: greedy longest-match pieces of all words; a word without a cover counts as one
    token and as unknown. Null, empty and blank texts have none. Of pieces that fit, the longest is
    taken, so there are no ties. Repeated rows are counted each for itself, texts of any length whole; other columns are
    ignored, whatever their names, and an empty table gives no rows.
    """

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = Automaton(*read_vocabulary(vocabulary))
        known: dict[bytes, int] = {}
        for texts in batches:
            rows = []
            for t in texts:
                found = t.encode("utf-8", "surrogatepass").split() if t else []
                try:
                    pieces = list(map(known.__getitem__, found))
                except KeyError:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for w in found:
                        if w not in known:
                            known[w] = machine.pieces(w)
                    pieces = list(map(known.__getitem__, found))
                unknown = pieces.count(-1)
                rows.append((len(found), sum(pieces) + 2 * unknown, unknown))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", count(F.col("text").cast("string")).alias("c")).select("doc_id", "c.*")
