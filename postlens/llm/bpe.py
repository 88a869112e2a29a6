"""Byte-level BPE by prefix-sharing trie traversal, and its decoder.

For every prefix of a word one token ends its encoding, and it follows from the last
tokens of shorter prefixes: the token is a suffix of the prefix that may stand after
the last token of what remains. Words are put in a trie and walked depth first, so a
prefix shared by many words gets its last token once; a word's encoding is read back
from the states on its path.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from postlens.llm.tokens import WORDS, Remembered, encoded, pieces, tokenizer_file
from postlens.llm.words import few_rows

class SuffixTokens(dict):
    """Longest token that ends a byte string, worked out once per string; None if there is none."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids

    def __missing__(self, tail: bytes) -> int | None:
        token = next((self.ids[tail[i:]] for i in range(len(tail)) if tail[i:] in self.ids), None)
        self[tail] = token
        return token


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        spec, raw = tokenizer_file(path)
        self.special = {entry["content"]: entry["id"] for entry in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.table = token_bytes(path)
        self.packed = {i: i.to_bytes(4, "little") for i in self.table}
        self.starts = {t[:i] for t in self.ids for i in range(len(t) + 1)}  # beginnings of tokens
        self.ending = SuffixTokens(self.ids)
        self.shorter: dict[int, int | None] = {}  # the next shorter token that ends a token
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b = self.ids[left], self.ids[right]
            self.merged[a, b] = rank
            self.halves[self.ids[left + right]] = (a, b, rank)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)

    def _apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens.

        Merges are undone in reverse order of rank, on the right edge of ``a`` and the
        left edge of ``b``; the pair at the border must never have merged earlier.
        """
        limit = len(self.merged)  # no merge has this rank
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            # of equal ranks the left one merges first, so the right one is undone first
            if right is None or left is not None and left[2] > right[2]:
                limit, a = left[2], left[1]
            else:
                limit, b = right[2] + 1, right[0]

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            known = self._apart(a, b)
            if len(self.pairs) < 300_000:
                self.pairs[a, b] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct words by one depth-first walk of their trie.

        The trie is held as the sorted word list: neighbours share the path of their
        common prefix, and sorted order is depth-first order. The states on the current
        path are, per prefix, the token that ends its encoding, that token's bytes, and
        the longest tail that begins a token, from which the tokens ending here follow.
        """
        out: dict[bytes, bytes] = {}
        starts, ending, pairs, packed, table = self.starts, self.ending, self.pairs, self.packed, self.table
        last: list[int] = [0]
        size: list[int] = [0]
        tails: list[bytes] = [b""]
        path = b""
        for word in sorted(words):
            shared = len(commonprefix((path, word)))
            del last[shared + 1:], size[shared + 1:], tails[shared + 1:]
            tail = tails[shared]
            for end in range(shared + 1, len(word) + 1):
                tail = tail + word[end - 1:end]
                while tail not in starts:
                    tail = tail[1:]
                token = ending[tail]
                while True:
                    n = len(table[token])
                    if n == end:
                        break
                    pair = (last[end - n], token)
                    fits = pairs.get(pair)
                    if self.may_follow(*pair) if fits is None else fits:
                        break
                    token = self._shorter(token)
                last.append(token)
                size.append(n)
                tails.append(tail)
            path = word
            tokens, end = [], len(word)
            while end:
                tokens.append(packed[last[end]])
                end -= size[end]
            tokens.reverse()
            out[word] = b"".join(tokens)
        return out

    def _shorter(self, token: int) -> int | None:
        if token not in self.shorter:
            self.shorter[token] = self.ending[self.table[token][1:]]
        return self.shorter[token]


class TrieEncoder:
    """Packed ids of texts; the new distinct words of a call share one trie walk.

    Pieces between single spaces and words are remembered with their ids, at most
    ``limit`` of each.
    """

    def __init__(self, path: str, limit: int = 150_000):
        self.vocabulary = Vocabulary(path)
        self.pieces, self.words = Remembered(limit), Remembered(limit)

    def _learn(self, parts: list[str]) -> None:
        """Work out the ids of pieces, each with its own leading space."""
        vocabulary = self.vocabulary
        find, special = vocabulary.words.findall, vocabulary.special
        cut: dict[str, list[str]] = {}
        for part in parts:
            if vocabulary.split and "<" in part and len(split := vocabulary.split.split(part)) > 1:
                cut[part] = [w for text in split for w in ([text] if text in special else find(text))]
            else:
                cut[part] = find(part)
        fresh = set(chain.from_iterable(cut.values())) - self.words.keys()
        raw = {w.encode(): w for w in fresh if w not in special}
        new = {raw[w]: packed for w, packed in vocabulary.encode_words(list(raw)).items()}
        new |= {w: special[w].to_bytes(4, "little") for w in fresh if w in special}
        self.words.learn(new)
        self.pieces.learn({part: b"".join(map(self.words.__getitem__, own)) for part, own in cut.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            parts = pieces(text)
            cut.append([parts[0], *[" " + part for part in parts[1:]]])
        self._learn(list(set(chain.from_iterable(cut)) - self.pieces.keys()))
        return [b"".join(map(self.pieces.__getitem__, parts)) for parts in cut]


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id; all that decoding needs."""
    spec, raw = tokenizer_file(path)
    special = {entry["content"]: entry["id"] for entry in spec["added_tokens"]}
    return {i: raw(t) for t, i in spec["model"]["vocab"].items() if t not in special} | {
        i: content.encode() for content, i in special.items()}


@functools.cache
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``: ids packed as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library without special tokens added. A null or empty text
    has no ids; texts of any length are encoded whole; an endless word costs time in
    proportion to its length. Rows are independent, so repeated rows agree; an empty
    table stays empty; an input column named ``out_col`` is replaced.
    """
    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = trie_encoder(path)
        for batch in batches:
            yield encoded(batch, codec.encode)

    return few_rows(docs).withColumn(out_col, ids(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the text of packed ids, special tokens kept.

    Bytes that are not UTF-8 become U+FFFD; an id outside the vocabulary is an error.
    Null ids give an empty text.
    """
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_bytes(path)
        for batch in batches:
            rows = (np.frombuffer(ids.as_buffer() or b"", "<u4").tolist() for ids in batch)
            yield pa.array([b"".join(map(table.__getitem__, row)).decode("utf-8", "replace") for row in rows],
                           pa.string())

    return few_rows(docs).withColumn(out_col, text(F.col(ids_col)))
