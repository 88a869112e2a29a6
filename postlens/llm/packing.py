"""Best-fit packing planned on the histogram of lengths.

The plan needs one count per length, at most ``capacity`` rows whatever the corpus.
Best fit in falling length runs over those counts: bins that look alike are one group
with a count. Every place of a length in a group is a run of slots; pieces take the
slots by their rank within their length, in a join.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.tokens import packed_ids
from postlens.llm.words import carried, few_rows, restored
from postlens.session import written

PLAN_SCHEMA = "length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, per_sequence bigint, base bigint"


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots per length: ``(length, first rank, end rank, first sequence, per sequence, base offset)``.

    Slot ``k`` of a row lies in sequence ``first + k // per``, at offset ``base + (k % per) * length``.
    A step adds at most four groups, and a group holds at most sqrt(2 * capacity)
    different lengths, so the plan is bounded by ``capacity`` alone.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, count)
    spaces: list[int] = []  # the free spaces in use, rising
    sequences = 0

    def put(free: int, first: int, count: int) -> None:
        if free not in groups:
            groups[free] = []
            insort(spaces, free)
        groups[free].append((first, count))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                free = spaces[at]
                first, count = groups[free].pop()
                if not groups[free]:
                    del groups[free], spaces[at]
            else:
                free, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            per = free // length
            whole = min(count, left // per)
            if whole:
                rows.append((length, rank, rank + whole * per, first, per, capacity - free))
                put(free - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if left and whole < count:
                # fewer than fill one sequence: the last one of this length
                rows.append((length, rank, rank + left, first + whole, left, capacity - free))
                put(free - left * length, first + whole, 1)
                whole, rank, left = whole + 1, rank + left, 0
            if whole < count:
                put(free, first + whole, count - whole)
    return rows


def cut_lengths(n: Column, capacity: int) -> Column:
    """Array of (piece, start, length): whole pieces of ``capacity``, the first may be shorter."""
    count = F.ceil(n / F.lit(capacity)).cast("int")
    first = n - (count - 1) * capacity
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        i.alias("piece"),
        F.when(i == 0, F.lit(0)).otherwise(first + (i - 1) * capacity).cast("bigint").alias("start"),
        F.when(i == 0, first).otherwise(F.lit(capacity)).cast("bigint").alias("length"),
    ))).otherwise(F.array())


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: texts as ids and ``end_id``, long ones cut."""
    tail = end_id.to_bytes(4, "little").hex().upper()
    ids = few_rows(docs).select(id_col, packed_ids(F.col(text_col), path).alias("_ids"))
    ids = ids.withColumn("_ids", F.concat("_ids", F.expr(f"X'{tail}'")))
    parts = ids.select(id_col, "_ids", F.inline(cut_lengths(F.octet_length("_ids") / 4, capacity)))
    part = F.substring("_ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return parts.select(id_col, "piece", "start", "length", F.crc32(part).alias("ids_crc32"))


def best_fit(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id", piece_col: str = "piece",
             length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (replaced if there).

    Sequences hold at most ``capacity`` and are filled without gaps from 0. Pieces of
    length 0 or null take no place and get null; longer ones than ``capacity`` are an
    error. Ties and repeated rows take different slots. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    counts = pieces.where(F.col(length_col) > 0).groupBy(F.col(length_col).alias("n")).count()
    # at most capacity rows by arithmetic; one more shows a piece that does not fit
    histogram = {row["n"]: row["count"] for row in counts.limit(capacity + 1).collect()}
    if any(n > capacity for n in histogram):
        raise ValueError(f"a piece is longer than {capacity}")
    plan = spark.createDataFrame(plan_slots(histogram, capacity), PLAN_SCHEMA)

    # ranks within a length: counted in parts first, so that no length fills a task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).alias("_key"), F.col(piece_col).alias("_piece")]
    rows = pieces.select(carried(pieces), *order, F.col(length_col).alias("_length"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key", "_piece"), F.lit(parts)))
    by_part = rows.groupBy(F.col("_length").alias("_l"), F.col("_part").alias("_p")).count()
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("_l", "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_length", "_part").orderBy("_key", "_piece")
    ranked = rows.withColumn("_nth", F.row_number().over(inside))
    ranked = ranked.join(starts, F.col("_length").eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_p")), "left")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth") - 1)

    at_rank = (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    placed = ranked.join(F.broadcast(plan), (F.col("_length") == F.col("length")) & at_rank, "left")
    slot = F.col("_rank") - F.col("first_rank")
    sequence = F.col("first_sequence") + F.floor(slot / F.col("per_sequence"))
    offset = F.col("base") + (slot % F.col("per_sequence")) * F.col("_length")
    return restored(placed, pieces.columns, {
        "sequence_id": sequence.cast("bigint"), "offset": offset.cast("bigint"),
    })


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces in sequences; the texts are encoded once, only numbers are written.

    A null or empty text is the end id alone. Rows that repeat an id are packed each;
    a null id is packed like any other. Other columns are left out.
    """
    pieces = written(tokenized_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    return best_fit(pieces, capacity, id_col)
