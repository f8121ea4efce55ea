"""Edit-aware token counts: segment trees over pre-tokens, re-encoding only around edits."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysmith.llm.shared import small_batches

#: The vocabulary is a file of base64 tokens and ranks; pass another path where it lives elsewhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary. It never looks behind, and ahead by no
#: more than AHEAD characters past the end of a match.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
AHEAD = 2
LEAF = 64
PIECE = 1 << 20
CACHE = 400_000


class Counter(dict):
    """Token counts of pre-tokens; every distinct one is encoded once while it stays in the cache."""

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        count = self[piece] = len(self.encoding.encode_ordinary(piece))
        return count

    def measure(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of pre-tokens."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        return sizes, np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def measured(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Those of a text, about a million characters at a time: a pre-token always ends before white space
        that follows something else."""
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
            to = cut.start() + 1 if cut else len(text)
            parts.append(self.measure(self.pattern.findall(text[at:to])))
            at = to
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_CUT = re.compile(r"\S\s")


@lru_cache(maxsize=1)
def counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


class TokenTree:
    """Pre-tokens of a text in leaves, under a segment tree of characters and tokens."""

    def __init__(self, text: str, counts: Counter) -> None:
        self.text, self.counts = text, counts
        self.encoded = 0
        sizes, tokens = counts.measured(text)
        self._plant(sizes, tokens)

    def _plant(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        starts = range(0, max(len(sizes), 1), LEAF)
        self.leaves = [(sizes[i : i + LEAF], tokens[i : i + LEAF]) for i in starts]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        if len(sizes):
            self.sums[self.width : self.width + len(self.leaves), 0] = np.add.reduceat(sizes, list(starts))
            self.sums[self.width : self.width + len(self.leaves), 1] = np.add.reduceat(tokens, list(starts))
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pieces(self) -> int:
        return sum(len(s) for s, _ in self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last one past the end) and where it begins."""
        node, begin = 1, 0
        position = min(position, max(int(self.sums[1, 0]) - 1, 0))
        while node < self.width:
            node *= 2
            if position - begin >= self.sums[node, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def _set(self, leaf: int, sizes: np.ndarray, tokens: np.ndarray) -> None:
        change = np.array([sizes.sum(), tokens.sum()]) - self.sums[self.width + leaf]
        self.leaves[leaf] = (sizes, tokens)
        node = self.width + leaf
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are cut to the text."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        shift = len(replacement) - (stop - start)
        text = self.text[:start] + replacement + self.text[stop:]
        # Pre-tokens that end AHEAD or more characters before the edit are as they were.
        first, begin = self._leaf_at(max(start - AHEAD, 0))
        sizes, tokens = self.leaves[first]
        ends = begin + np.cumsum(sizes)
        keep = int(np.searchsorted(ends, start - AHEAD, side="right"))
        restart = int(ends[keep - 1]) if keep else begin
        # Encode on until a new boundary behind the edit is an old one, moved by the change of length.
        leaf, offset, old = first, keep, restart
        fresh: list[str] = []
        at, meets = restart, False
        for match in self.counts.pattern.finditer(text, restart):
            while old < stop or old + shift < at:
                if offset == len(self.leaves[leaf][0]):
                    if leaf + 1 == len(self.leaves):
                        break
                    leaf, offset = leaf + 1, 0
                else:
                    old += int(self.leaves[leaf][0][offset])
                    offset += 1
            meets = old >= stop and old + shift == at >= start + len(replacement) and at > restart
            if meets:
                break
            fresh.append(match.group())
            at = match.end()
        if not meets:
            leaf = len(self.leaves) - 1
            offset = len(self.leaves[leaf][0])
        self.encoded += len(fresh)
        more = self.counts.measure(fresh)
        rest = self.leaves[leaf][0][offset:], self.leaves[leaf][1][offset:]
        for i in range(first + 1, leaf + 1):
            self._set(i, rest[0][:0], rest[1][:0])
        self._set(
            first, np.concatenate([sizes[:keep], more[0], rest[0]]), np.concatenate([tokens[:keep], more[1], rest[1]])
        )
        self.text = text
        if len(self.leaves[first][0]) > 16 * LEAF:
            self._plant(np.concatenate([s for s, _ in self.leaves]), np.concatenate([t for _, t in self.leaves]))


def count_tokens(
    docs: DataFrame, edits: Column | None = None, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, n_pieces, edited_pieces, encoded_again) for every row of ``docs``.

    ``edits`` is a column of array<struct<start:int, length:int, replacement:string>>, applied in turn, each to
    the text that the one before left; positions are code points, 0-based, and cut to the text.  A NULL list or
    a NULL field is no edit.  n_tokens counts the text as given, edited_tokens the edited text: the tree of
    the text stays, pre-tokens near each edit are encoded again, and sums change along their paths.  NULL and
    empty texts have no tokens.  Rows are independent: repeated ones repeat, and nothing is shuffled.  The
    vocabulary (about a megabyte) travels with the function.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        raw = file.read()
    kind = "array<struct<start:int,length:int,replacement:string>>"
    changes = (F.array().cast(kind) if edits is None else edits.cast(kind)).alias("_edits")

    def counted(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counts = counter(raw)
        for texts, lists in frames:
            rows = []
            for value, steps in zip(texts, lists):
                tree = TokenTree(value or "", counts)
                before, pieces = tree.total, tree.pieces
                for step in steps if steps is not None else ():
                    if step is not None and not any(pd.isna(step[c]) for c in ("start", "length", "replacement")):
                        tree.edit(int(step["start"]), int(step["length"]), step["replacement"])
                rows.append((before, tree.total, pieces, tree.pieces, tree.encoded))
            names = ["n_tokens", "edited_tokens", "n_pieces", "edited_pieces", "encoded_again"]
            yield pd.DataFrame(rows, columns=names, dtype="int64")

    result = "n_tokens long, edited_tokens long, n_pieces long, edited_pieces long, encoded_again long"
    udf = F.pandas_udf(counted, result)
    found = docs.select(F.col(key).alias("doc_id"), udf(F.col(text), changes).alias("_n"))
    return found.select("doc_id", "_n.*")
