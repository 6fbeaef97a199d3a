"""Operator 2: token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number
of pieces popped when the link is followed.  One left-to-right walk over a
word, without back-tracking, then gives the length of its greedy
longest-match split; the pieces themselves are never built.

A byte vocabulary has two kinds of pieces: those that start a word (stored
with a leading space in the file) and those that continue one.  Every single
byte is a piece of both kinds, so that every word has a split.

Defined cases: NULL or empty text, or white space alone: 0 words, 0 tokens.
Repeated rows and repeated ids are counted row by row.  Bytes beyond ASCII are
ordinary bytes of the UTF-8 form; a word of any length is walked once.
"""

from __future__ import annotations

import base64
from collections import deque

from pyspark.sql import DataFrame, SparkSession

from .common import map_batches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a Python worker remembers; more only cost time.
REMEMBERED_WORDS = 400_000

_BUILT: dict[int, "WordPieceCounter"] = {}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, continuation pieces) of a base64 rank file.

    Pieces with white space elsewhere than as one leading space can't occur
    inside a word and are left out.
    """
    first, rest = {bytes([b]) for b in range(256)}, {bytes([b]) for b in range(256)}
    with open(path, "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0])
            into = first if piece[:1] == b" " else rest
            piece = piece[1:] if piece[:1] == b" " else piece
            if piece.split() == [piece]:
                into.add(piece)
    return sorted(first), sorted(rest)


class WordPieceCounter:
    """Failure-link automaton over bytes; ``count(word)`` is linear in the word."""

    def __init__(self, first: list[bytes], rest: list[bytes]):
        # node 0 starts a word, node 1 continues one
        self.go: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                v = root
                for b in p:
                    nxt = self.go[v].get(b)
                    if nxt is None:
                        nxt = len(self.go)
                        self.go.append({})
                        ends.append(False)
                        self.go[v][b] = nxt
                    v = nxt
                ends[v] = True
        n = len(self.go)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for b, v in self.go[u].items():
                if ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and b not in self.go[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.go[z][b], pops
                todo.append(v)
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        v = total = 0
        for b in word:
            nxt = go[v].get(b)
            while nxt is None:
                total += popped[v]
                v = fail[v]
                nxt = go[v].get(b)
            v = nxt
        while v != 1 and v != 0:
            total += popped[v]
            v = fail[v]
        return total

    def count_all(self, words: list[bytes]) -> int:
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= 64:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens (longs).  The vocabulary file is read on the driver only."""
    spark: SparkSession = docs.sparkSession
    pieces = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # one vocabulary, 1 MB

    def count(cols: dict[str, list]) -> dict[str, list]:
        built = _BUILT.get(pieces.id if hasattr(pieces, "id") else 0)
        if built is None:
            built = WordPieceCounter(*pieces.value)
            _BUILT.clear()
            _BUILT[pieces.id if hasattr(pieces, "id") else 0] = built
        words = [(t or "").encode().split() for t in cols["text"]]
        return {"id": cols["id"], "n_words": [len(w) for w in words],
                "n_tokens": [built.count_all(w) for w in words]}

    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
