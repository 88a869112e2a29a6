"""Word and shingle hashing shared by the text operators; small helpers for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

MIXER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of a word, looked up once per distinct word; holds at most ``limit`` words."""

    def __init__(self, limit: int = 1 << 19):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


HASHES = WordHashes()


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per window of ``size`` consecutive words; empty if there are fewer."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, size):
        out *= MIXER
        out += hashes[i:count + i]
    out ^= out >> np.uint64(31)
    out *= FINAL
    out ^= out >> np.uint64(29)
    return out


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, none gives none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def carried(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that names made on the way cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def restored(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns carried in ``_row`` in their order, with ``new`` replaced in place or added."""
    old = [new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return df.select(*old, *[value.alias(name) for name, value in new.items() if name not in columns])


ROWS_PER_BATCH = 1000


def few_rows(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches held to few rows: whole texts can be very long.

    Only what a task holds at once changes, never a result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(key))
    if not 0 < now <= ROWS_PER_BATCH:
        docs.sparkSession.conf.set(key, str(ROWS_PER_BATCH))
    return docs
