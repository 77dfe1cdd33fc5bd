"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie over bytes and an end-of-word mark. Every node has a failure link and the number
of pieces that are popped when the walk must take it, both computed beforehand, so one pass over a word gives the
length of its greedy longest-match segmentation in time linear in the word, without building a piece.

Pieces that end in the mark match at a word's end only; where the last piece has no mark, the mark counts nothing.
Words are runs of letters, single digits, contractions and runs of other signs, after lower-casing, as the vocabulary
wants them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END_MARK = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = 256
MEMO = 120_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others in order for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str, end_mark: str = END_MARK) -> list[tuple[bytes, bool]]:
    """(bytes, whether the piece ends a word) of each piece of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet, out = byte_alphabet(), []
    for piece in vocabulary:
        ends = piece.endswith(end_mark)
        body = piece[: -len(end_mark)] if ends else piece
        if body and all(c in alphabet for c in body):
            out.append((bytes(alphabet[c] for c in body), ends))
    return out


class LongestMatch:
    """Counts pieces of words; a word with a byte that no piece can take counts as one unknown piece."""

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        piece_at: list[int] = [-1]  # pieces that the node itself stands for: 1, or 0 for the bare mark, else -1

        def add(symbols: Iterable[int], counts: int) -> None:
            node = 0
            for s in symbols:
                if s not in self.next[node]:
                    self.next[node][s] = len(self.next)
                    self.next.append({})
                    piece_at.append(-1)
                node = self.next[node][s]
            piece_at[node] = counts

        for body, ends in pieces:
            add([*body, END] if ends else body, 1)
        add([END], 0)
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque((0, s, v) for s, v in self.next[0].items())
        while queue:
            u, s, v = queue.popleft()
            if piece_at[v] >= 0:
                self.fail[v], self.pops[v] = 0, piece_at[v]
            else:
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and s not in self.next[z]:
                    popped, z = popped + self.pops[z], self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][s], popped
            queue.extend((v, x, w) for x, w in self.next[v].items())

    def count(self, word: bytes) -> int:
        node, total = 0, 0
        following, fail, pops = self.next, self.fail, self.pops
        for s in (*word, END):
            while (to := following[node].get(s)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


class ChunkCounts(dict):
    """What stands between white space -> (pieces, words), remembered up to a bound."""

    def __init__(self, automaton: LongestMatch, split: str) -> None:
        super().__init__()
        self.automaton, self.find = automaton, regex.compile(split).findall

    def __missing__(self, chunk: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        words = self.find(chunk.lower())
        out = sum(self.automaton.count(w.encode("utf-8", "replace")) for w in words), len(words)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end_mark: str = END_MARK, split: str = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words for every row.

    Null and empty texts have no tokens. Each row has its own result, repeated ones too; ids may be null. No rows give
    no rows. Other columns are ignored. The vocabulary is read by the driver; its size bounds what executors get."""
    modest_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, end_mark))

    @F.pandas_udf("n_tokens long, n_words long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = ChunkCounts(LongestMatch(pieces.value), split)
        for texts in batches:
            tokens, words = [], []
            for text in texts:
                t = w = 0
                for a, b in map(memo.__getitem__, text.split() if text else ()):
                    t += a
                    w += b
                tokens.append(t)
                words.append(w)
            yield pd.DataFrame({"n_tokens": tokens, "n_words": words})

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), counted(F.col(text_col)).alias("c"))
    return out.select("doc_id", "c.n_tokens", "c.n_words")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
