"""Lines repeated across documents: explode, hash, count documents, drop, reassemble by position.

Only 128-bit line hashes and positions are shuffled; the texts themselves meet the
positions to drop in one join by document. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.words import carried, restored
from postlens.operators.scaling import unrolled

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the general function is the same on pure ASCII and much faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    """Lines split at ``\\n``; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_line_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``(id, text hash, drop)``: per document the zero-based positions of its lines to drop.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses its lines everywhere but in the smallest document id holding it.
    """
    # rows that repeat an id with another text keep positions of their own
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    keys = F.transform(lines_of(F.col("_text")), line_key)
    lines = unrolled(base.where(F.col("_id").isNotNull()), ["_id", "_hash"], keys, "_pos", "_key")
    lines = lines.where(F.length("_key") >= min_chars)
    hashed = lines.select(
        "_id", "_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), F.col("_key")).alias("_h2")
    )
    # documents are distinct per hash before they are counted, so no hash fills a task
    held = hashed.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
    spread = held.groupBy("_h1", "_h2").agg(F.min("_id").alias("_keeper"), F.count("_one").alias("_docs"))
    repeated = spread.where(F.col("_docs") >= min_docs).drop("_docs")
    found = hashed.join(repeated, ["_h1", "_h2"]).where(F.col("_id") != F.col("_keeper"))
    # bounded by one document's lines
    return found.groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2, prefix: str = "") -> DataFrame:
    """``docs`` with the text rid of repeated lines, ``n_lines`` before and ``n_dropped``.

    Null and empty texts are one empty line and stay (null becomes empty). Rows that
    repeat a document id count as one document, each with its own lines. A null id
    takes no part: its row is kept whole. An empty table gives an empty one. Added
    columns are named with ``prefix``; an input column of the same name is replaced.
    """
    drops = repeated_line_positions(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_own"), carried(docs))
    joined = rows.join(drops, (F.col("_key") == F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    joined = joined.withColumn("_lines", lines_of(F.col(f"_row.`{text_col}`")))
    count = F.size("_lines")
    # array_except works by hash, so a text of very many lines stays linear
    places = F.array_except(F.sequence(F.lit(0), count - 1), F.col("_drop"))
    kept = F.transform(places, lambda i: F.get("_lines", i))
    text = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return restored(joined, docs.columns, {
        text_col: text, f"{prefix}n_lines": count.cast("bigint"),
        f"{prefix}n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint"),
    })
