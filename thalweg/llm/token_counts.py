"""Greedy word-piece counts by a linear longest-match automaton (Song et al., Fast WordPiece Tokenization, 2021).

The vocabulary is a byte trie. Each node has a failure link and the number of pieces that are emitted ("popped") when the
link is followed, so a word is scanned once, left to right, and its pieces are counted without being built.
"""

from __future__ import annotations

import base64
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a Python worker remembers before it starts afresh.
MEMO_WORDS = 300_000


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file: a base64 piece and its rank on each line. A piece that starts a word begins with a space."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Counts greedy longest-match pieces. A word that the vocabulary cannot spell counts as one (unknown) piece."""

    def __init__(self, vocabulary: list[bytes]):
        self.goto: dict[int, int] = {}
        last, parent, depth_bytes = [False], [0], [0]
        for piece in vocabulary:
            node = 0
            for c in piece:
                key = node << 8 | c
                if (to := self.goto.get(key)) is None:
                    to = self.goto[key] = len(last)
                    last.append(False)
                    parent.append(node)
                    depth_bytes.append(c)
                node = to
            last[node] = node != 0
        children: dict[int, list[int]] = {}
        for node in range(1, len(last)):
            children.setdefault(parent[node], []).append(node)
        #: -1: no link
        self.fail, self.pops = [-1] * len(last), [0] * len(last)
        todo = deque(children.get(0, []))
        while todo:
            node = todo.popleft()
            todo.extend(children.get(node, []))
            if last[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parent[node]], self.pops[parent[node]]
            while at != -1 and (to := self.goto.get(at << 8 | depth_bytes[node])) is None:
                popped += self.pops[at]
                at = self.fail[at]
            if at != -1:
                self.fail[node], self.pops[node] = to, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word (given with its leading space)."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = n = 0
        for c in word:
            while (to := goto.get(node << 8 | c)) is None:
                if fail[node] == -1:
                    return 1
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] == -1:
                return 1
            n += pops[node]
            node = fail[node]
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_words, n_tokens.

    Words are runs of bytes other than ASCII white space; each is matched with one leading space.
    Null or empty text: zeros. Repeated rows come back as they are, ids of any type, null ones too. Empty table: no rows.
    A map over input partitions: nothing is shuffled; the automaton (bounded by the vocabulary) is broadcast.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_vocabulary(vocabulary)))

    def start():
        count, memo = automaton.value.count, {}

        def work(texts):
            n_bytes, n_words, n_tokens = [], [], []
            for text in texts:
                data = text.encode()
                found = Counter(data.split())
                n = 0
                for word, times in found.items():
                    if (k := memo.get(word)) is None:
                        k = memo[word] = count(b" " + word)
                    n += k * times
                n_bytes.append(len(data)), n_words.append(found.total()), n_tokens.append(n)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
            return n_bytes, n_words, n_tokens

        return work

    return map_texts(docs, text_col, {"doc_id": F.col(id_col)}, {"n_bytes": "long", "n_words": "long", "n_tokens": "long"}, start)
