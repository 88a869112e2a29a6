"""Quality rules: word and line counts, and compression bands by text length.

One map over whole texts, no shuffle. Counts are exact; the bands state between which
zstandard ratios (compressed size / size) running text of a length lies. Lower means
repetitive, higher means incompressible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from postlens.llm.words import carried, few_rows, restored, texts_of, window_hashes, word_hashes

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits per length: ``(bytes below, lowest ratio, highest ratio)``, in rising length.

    Short texts hold too little to repeat and pay the frame header, so limits start
    wide and narrow with length. Chunks are judged by the band of their own length;
    a text fails when more than ``bad_share`` of its chunks do.

    ``highest`` holds ``(bytes, highest ratio)``, interpolated by the logarithm of the
    length: 0.005 to 0.05 above the greatest ratio of 10,000 texts (sf0.1) and their chunks
    from 128 bytes on. It holds for text of at most ``plain`` bytes per character; other
    scripts have only the upper limits of ``limits``. Random characters of 64 or 36 kinds
    lie above it from 300 bytes on, of 26 kinds from 1000 bytes on; below, prose is as dense.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.0, 9.9), (128, 0.40, 9.9), (256, 0.35, 1.30), (512, 0.30, 1.00), (1024, 0.27, 0.90),
        (2048, 0.24, 0.80), (4096, 0.22, 0.74), (8192, 0.20, 0.70), (float("inf"), 0.16, 0.68),
    )
    highest: tuple[tuple[float, float], ...] = (
        (128, 1.0), (234, 0.875), (280, 0.775), (512, 0.71), (700, 0.675), (1000, 0.612), (1450, 0.582),
        (2048, 0.555), (4096, 0.52), (8192, 0.50),
    )
    plain: float = 1.25
    chunk_bytes: int = 2048
    shortest_chunk: int = 512
    bad_share: float = 0.3
    level: int = 3

    def within(self, data: bytes, ratio: float) -> bool:
        size = len(data)
        low, high = next((low, high) for below, low, high in self.limits if size < below)
        if size >= self.highest[0][0] and size <= self.plain * len(data.translate(None, CONTINUATION)):
            at, most = zip(*self.highest)
            high = min(high, float(np.interp(np.log2(size), np.log2(at), most)))
        return low <= ratio <= high


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"
)


def repeat_words(hashes: np.ndarray, window: int) -> int:
    """Words inside windows that occur at least twice, the first occurrence included."""
    seen = window_hashes(hashes, window)
    ordered = np.sort(seen)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    upto = np.concatenate([[0], np.cumsum(np.isin(seen, twice))])
    place = np.arange(len(hashes))
    last = np.minimum(place, len(seen) - 1) + 1
    return int(np.count_nonzero(upto[last] > upto[np.maximum(place - window + 1, 0)]))


def measure(data: bytes, bands: Bands, press: zstandard.ZstdCompressor,
            min_words: int, window: int, max_repeat_percent: int) -> tuple:
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeat_words(word_hashes(words), window) if len(words) > window else 0
    failed = len(words) < min_words or 100 * repeated > max_repeat_percent * len(words)
    ratio = len(press.compress(data)) / len(data) if data else 0.0
    chunks = bad = 0
    for at in range(0, len(data), bands.chunk_bytes):
        chunk = data[at:at + bands.chunk_bytes]
        if len(chunk) >= bands.shortest_chunk:
            chunks += 1
            bad += not bands.within(chunk, len(press.compress(chunk)) / len(chunk))
    fits = bool(data) and bands.within(data, ratio) and bad <= bands.bad_share * chunks
    return (
        len(words), len(data.translate(None, SPACE + CONTINUATION)), len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, failed, ratio, chunks, bad, fits and not failed,
    )


def quality_rules(docs: DataFrame, text_col: str = "text", bands: Bands = Bands(), min_words: int = 20,
                  window: int = 8, max_repeat_percent: int = 30, prefix: str = "") -> DataFrame:
    """``docs`` with the columns of ``SCHEMA`` (named with ``prefix``) added.

    A null or empty text has no words and fails. Very long texts are measured whole.
    Rows are judged alone, so repeated rows get equal results and an empty table
    gives an empty one. An input column of an added column's name is replaced.
    """
    kinds = [part.split() for part in SCHEMA.split(", ")]
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    shape = pa.struct([(name, arrow[kind]) for name, kind in kinds])

    @F.arrow_udf(f"struct<{', '.join(f'{n}:{k}' for n, k in kinds)}>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [measure(t or b"", bands, press, min_words, window, max_repeat_percent) for t in texts_of(batch)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), shape.field(i).type) for i, c in enumerate(columns)], fields=list(shape)
            )

    judged = few_rows(docs).select(carried(docs), judge(F.col(text_col)).alias("_judged"))
    return restored(judged, docs.columns, {f"{prefix}{name}": F.col(f"_judged.{name}") for name, _ in kinds})
