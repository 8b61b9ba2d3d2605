"""Operator 5: greedy word-piece counts by a linear longest-match automaton.

A trie over the vocabulary's bytes gets failure links: where a node has no child for the next byte, the pieces that
are certain by then are popped and matching goes on at the link's node. Only the number of popped pieces is kept
at each node, so a word's count needs one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm.shared import small_batches

#: Largest vocabulary that is broadcast.
MAX_VOCABULARY = 2_000_000
#: Counts of words that a task remembers.
MEMO = 500_000
_WORD = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= ?[^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
_BUILT: dict[str, LongestMatch] = {}


class LongestMatch:
    """Counts of the pieces that greedy longest match from the left makes of a word's bytes."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.child: dict[int, int] = {}
        piece, kids = [False], [[]]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(piece)
                    kids[node].append((byte, len(piece)))
                    piece.append(False)
                    kids.append([])
                node = self.child[key]
            piece[node] = node > 0
        self.link, self.popped = [-1] * len(piece), [0] * len(piece)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, kid in kids[node]:
                queue.append(kid)
                if piece[kid]:
                    self.link[kid], self.popped[kid] = 0, 1
                    continue
                at, n = self.link[node], self.popped[node]
                while at >= 0 and (at << 8 | byte) not in self.child:
                    n += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[kid], self.popped[kid] = self.child[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        """The number of pieces; 1, the unknown piece, for a word that the vocabulary can't spell."""
        child, link, popped, node, n = self.child, self.link, self.popped, 0, 0
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


class _Counts(dict):
    """Counts by word, worked out when first asked for."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) < MEMO and len(word) <= 64:
            self[word] = n
        return n


def read_vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    """The tokens of a file with a base64 token and its rank on each line."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", " ")[0].alias("token"))
    found = rows.limit(MAX_VOCABULARY + 1).collect()
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY} tokens")
    return [base64.b64decode(r["token"]) for r in found]


def token_counts(documents: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> DataFrame:
    """``documents`` under a struct ``doc``, with ``n_tokens`` and ``n_words``.

    A text is cut into words with at most one space before each, and runs of other white space; each is matched by itself. Null and empty texts
    have no tokens. Every row returns, repeated ones too.
    """
    small_batches(documents.sparkSession)
    tokens = documents.sparkSession.sparkContext.broadcast(vocabulary)
    name = uuid.uuid4().hex

    @F.pandas_udf("n_tokens long, n_words long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = LongestMatch(tokens.value)
        counts = _Counts(_BUILT[name])
        for texts in batches:
            rows = []
            for text in texts:
                words = _WORD.findall((text or "").encode("utf-8", "replace"))
                rows.append((sum(map(counts.__getitem__, words)), sum(1 for w in words if w.strip())))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_words"])

    rows = documents.select(F.struct("*").alias("doc"), count(F.col(text_col).cast("string")).alias("c"))
    return rows.select("doc", "c.n_tokens", "c.n_words")
