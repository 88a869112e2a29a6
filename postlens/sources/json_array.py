"""JSON arrays of any size, read in splits.

A file is read as text parted at its commas, so Spark cuts it at any byte. Whether a
comma parts two elements depends on the quotes and brackets before it, which no split
knows. So a first pass finds what each split does to that state - for a split that
starts inside a string and for one that does not - and a window over the splits of a
file, one row each, composes these into the state each split starts in. A second pass
then cuts the elements; only the pieces of elements that lie across splits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.operators.scaling import fits
from postlens.session import written

ESCAPED = re.compile(r"\\.", re.DOTALL)
BLANK = "\ufeff \t\r\n"
SPLIT_ROWS = 1_000_000
EFFECT = "file string, start bigint, odd boolean, plain int, quoted int, first string"
PIECE = "file string, start bigint, n bigint, begins boolean, ends boolean, piece string, listed boolean"


def effect(fragment: str) -> tuple[bool, int, int]:
    """Whether quotes are left open, and by how much brackets deepen outside, or else inside, of strings."""
    bare = ESCAPED.sub("", fragment) if "\\" in fragment else fragment
    depth, inside = [0, 0], 1
    for part in bare.split('"'):
        inside ^= 1
        depth[inside] += part.count("[") + part.count("{") - part.count("]") - part.count("}")
    return bool(inside), depth[0], depth[1]


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its effect, and the first character of the file where it starts there."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for text, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
            state = found.get((file, start))
            if state is None:
                state = found[file, start] = [False, 0, 0, "" if start else text.lstrip(BLANK)[:1]]
            odd, plain, quoted = effect(text)
            # a split that starts inside a string sees every fragment the other way round
            state[1] += quoted if state[0] else plain
            state[2] += plain if state[0] else quoted
            state[0] ^= odd
    yield pa.RecordBatch.from_pylist(
        [dict(zip(("file", "start", "odd", "plain", "quoted", "first"), (*at, *state))) for at, state in found.items()],
        pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("plain", pa.int32()), ("quoted", pa.int32()), ("first", pa.string())]))


def _pieces(partial_only: bool):
    """Elements of each split, in pieces where they lie across splits."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []

        def emit(ends: bool) -> None:
            text = ",".join(parts)
            if base and ends and depth == 0:
                text = text.rstrip()
                text = text[:-1] if text.endswith("]") else text
                # nothing between the brackets
                if opened and not text.strip():
                    return
            if not partial_only or not (begins and ends):
                out.append((*at, n, begins, ends, text, bool(base)))

        for batch in batches:
            for text, file, start, quoted, level, first in zip(
                    *(batch.column(c).to_pylist() for c in ("value", "file", "start", "in_string", "depth", "first"))):
                if (file, start) != at:
                    if at is not None and parts is not None:
                        emit(ended)
                    at, inside, depth, base, n = (file, start), quoted, level, int(first == "["), 0
                    begins, opened, parts, ended = start == 0 or bool(base) and not inside and depth == base, False, [], False
                if parts is None:
                    n, begins, opened, parts = n + 1, True, False, []
                if base and start == 0 and depth == 0 and not parts and n == 0:
                    text, depth, opened = text[text.index("[") + 1:], 1, True
                odd, plain, other = effect(text)
                depth += other if inside else plain
                inside ^= odd
                parts.append(text)
                ended = depth == 0 and not inside
                if base and not inside and depth == base:
                    emit(True)
                    parts = None
            if out:
                yield _batch(out)
                out.clear()
        if at is not None and parts is not None:
            emit(ended)
        yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_())
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "start", "n", "begins", "ends", "piece", "listed"])


def split_states(fragments: DataFrame) -> DataFrame:
    """``(file, start, in_string, depth, first)``: the state in which each split of a file starts."""
    splits = fragments.mapInArrow(_effects, EFFECT)
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    deeper = F.when(F.col("in_string"), F.col("quoted")).otherwise(F.col("plain"))
    return splits.withColumn("in_string", quoted).select(
        "file", "start", "in_string", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth"),
        F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))


def json_elements(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """``(file, pos, element, listed)``: the texts of the elements of JSON arrays, ``pos`` from 0 in each file.

    Without ``numbered`` there is no ``pos`` and the files are read once less. A file that
    holds no array is one element, not ``listed``. Splits follow ``spark.sql.files.*`` and never
    change the result. A file cut short gives its whole elements and the rest as a last one.
    """
    fragments = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states = written(split_states(fragments), "json_splits")
    # a row per split: 100 TB are under a million splits of the usual size
    if fits(states, SPLIT_ROWS):
        entered = fragments.join(F.broadcast(states), ["file", "start"])
    else:
        placed = fragments.withColumn("_i", F.monotonically_increasing_id()).join(states, ["file", "start"])
        entered = placed.repartition("file", "start").sortWithinPartitions("file", "start", "_i")
    several = not states.where(F.col("start") > 0).isEmpty()
    columns = ("value", "file", "start", "in_string", "depth", "first")
    pieces = entered.select(*columns).mapInArrow(_pieces(False), PIECE)
    whole = pieces.where("begins AND ends")
    if several:
        parts = entered.select(*columns).mapInArrow(_pieces(True), PIECE)
        order = Window.partitionBy("file").orderBy("start", "n")
        owned = parts.withColumn("_owner", F.sum(F.col("begins").cast("int")).over(order))
        # bounded by one element
        joined = owned.groupBy("file", "_owner").agg(
            F.min(F.struct("start", "n")).alias("_at"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "piece"))), lambda p: p["piece"]), ",").alias("piece"),
            F.first("listed").alias("listed"))
        whole = whole.select("file", "start", "n", "piece", "listed").unionByName(joined.select("file", "_at.start", "_at.n", "piece", "listed"))
    else:
        whole = pieces.select("file", "start", "n", "piece", "listed")
    if not numbered:
        return whole.select("file", F.col("piece").alias("element"), "listed")
    begun = whole.groupBy("file", "start").agg(F.count("*").alias("_c"), F.min("n").alias("_least"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("file", "start", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    side = F.broadcast(begun) if fits(begun, SPLIT_ROWS) else begun
    return whole.join(side, ["file", "start"]).select(
        "file", (F.col("_shift") + F.col("n")).alias("pos"), F.col("piece").alias("element"), "listed")
