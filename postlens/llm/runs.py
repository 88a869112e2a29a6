"""Stretches of words that repeat with a period, found by splitting and scanning by lag.

A run of period q is a stretch of words equal to themselves q words on, of at least
``max(least_words, copies * q)`` words, that no neighbouring word extends. Every word of
a run occurs at least ``copies`` times in it. So a text is split at the words that occur
less often within their segment, and every segment again by its own counts, until no
word is left to split at; in prose hardly a segment survives. The segments that do are
scanned by lag, one octave of lags at a time: with windows twice as long as the octave's
smallest lag, a run shows as consecutive windows that all come again at the same
distance, and its ends are then found word by word at that lag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.words import few_rows, texts_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def surviving(ids: np.ndarray, copies: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, numbers)`` of the words left by splitting; equal numbers are equal words of one segment."""
    places, segment = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while True:
        _, own, count = np.unique(segment * (len(ids) + 1) + ids[places], return_inverse=True, return_counts=True)
        often = count[own] >= copies
        starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        lengths = np.diff(np.append(starts, len(places)))
        keep = often & np.repeat(lengths >= least_words, lengths)
        if keep.all():
            return places, own
        places = places[keep]
        if not len(places):
            return places, places
        segment = np.cumsum(np.diff(places, prepend=-2) != 1)


def _ends(ids: np.ndarray, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``low`` to ``high`` in which every word equals the word ``lag`` on; grown by doubling."""
    step = 64
    while high + lag < len(ids):
        same = ids[high:high + step] [: max(0, len(ids) - lag - high)] == ids[high + lag:high + lag + step]
        if not same.all():
            high += int(np.argmin(same))
            break
        high += len(same)
        step *= 2
    step = 64
    while low > 0:
        at = max(0, low - step)
        same = ids[at:low] == ids[at + lag:low + lag]
        if not same.all():
            low = at + len(same) - int(np.argmin(same[::-1]))
            break
        low = at
        step *= 2
    return low, high


def find_runs(words: list[bytes], copies: int = 4, least_words: int = 6) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period."""
    if copies < 4:
        raise ValueError("a window of an octave is sure to lie in a run of four copies only")
    if len(words) < least_words:
        return []
    ids = numbered(words)
    places, window = surviving(ids, copies, least_words)
    found: set[tuple[int, int, int]] = set()
    length, lag = 1, 1
    while len(window) > lag:
        # windows of twice the octave's smallest lag; words of two segments never make one twice
        count = len(window) - length
        if count < 1:
            break
        _, window = np.unique(window[:count] * (len(places) + 1) + window[length:length + count], return_inverse=True)
        length *= 2
        order = np.argsort(window, kind="stable")
        again = window[order][1:] == window[order][:-1]
        if not again.any():
            break
        distance = np.zeros(count, np.int64)
        distance[order[:-1][again]] = np.diff(order)[again]
        at = np.flatnonzero((distance >= lag) & (distance < 2 * lag))
        if len(at):
            parts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(distance[at], prepend=-1) != 0))
            sizes = np.diff(np.append(parts, len(at)))
            for first, size in zip(at[parts].tolist(), sizes.tolist()):
                period = int(distance[first])
                if size <= period:
                    continue
                low, high = _ends(ids, period, int(places[first]), int(places[first]) + size)
                total = high - low + period
                if total >= max(least_words, copies * period):
                    found.add((low, total, period))
        lag *= 2
    return sorted(found)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words left when every run keeps its first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered]


def periodic_runs(docs: DataFrame, text_col: str = "text", copies: int = 4, least_words: int = 6,
                  prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period by start) and the ``collapsed`` text.

    ``collapsed`` joins the kept words by one space; in every run the first period is
    kept, and what another run drops stays dropped. Words are parted by ASCII white
    space; null and empty texts have none, no run, and collapse to the empty text. Texts
    of any length are read whole: sorting at every octave of lags makes the time near
    linear. Rows stay as they are, repeated ones too; an empty table gives an empty one.
    Input columns with the names of added ones (after ``prefix``) are replaced.
    """
    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS}, collapsed: string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in texts_of(batch):
                words = WORD.findall(text or b"")
                own = find_runs(words, copies, least_words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(kept_words(words, own)).decode())
            fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(fields)), pa.array(texts, pa.string())],
                ["n_words", "runs", "collapsed"])

    names = ["n_words", "runs", "collapsed"]
    added = [f"{prefix}{n}" for n in names]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    # named after no column of the input
    held = "_scan_" + "_".join(docs.columns)
    found = few_rows(docs).withColumn(held, scan(F.col(f"`{text_col}`")))
    return found.select(*rest, *[F.col(f"`{held}`.{n}").alias(a) for n, a in zip(names, added)])


def longest(runs: Column) -> Column:
    """The run of greatest length; the smallest start, then period, among equals; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(
        best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def listing(runs: Column) -> Column:
    """``start,length,period`` and a line end per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
