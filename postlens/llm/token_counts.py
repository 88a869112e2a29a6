"""Token counts per document in flat token files without an index.

A flat file is the ids of its documents end to end, each document closed by an end
id. Files are read in blocks; each block is searched for the end id with one vector
comparison, and documents that cross blocks are stitched by a prefix scan over one
small row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlens.llm.tokens import encoded, encoder
from postlens.llm.words import few_rows

FILE_ROWS = 2048  # documents in a file; a partition of more has several, numbered by Spark's writer
PART_NUMBER = r"-c(\d+)[^/]*$"


def write_flat(docs: DataFrame, tokenizer: str, folder: str, end_id: int, width: int = 2,
               text_col: str = "text") -> None:
    """Write the ids of all texts as flat files of little-endian ids of ``width`` bytes.

    Every document ends with ``end_id``; a null or empty text is that id alone. Strings
    of special tokens in a text are ordinary text, so they end no document. The line separator of Spark's text writer is the end id, so any store Spark writes to
    will do. An id that does not fit ``width`` is an error. A partition is written as files of
    ``FILE_ROWS`` documents, since a reader holds a whole file.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    @F.arrow_udf("binary")
    def flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, most = encoder(tokenizer, ordinary=True), 1 << 8 * width
        def narrow(packed: bytes) -> bytes:
            ids = np.frombuffer(packed, "<u4")
            if len(ids) and int(ids.max()) >= most:
                raise ValueError(f"an id needs more than {width} bytes")
            return ids.astype(kind).tobytes()

        for batch in batches:
            yield encoded(batch, lambda texts: list(map(narrow, codec.encode(texts))))

    raw = few_rows(docs).select(flat(F.col(text_col)).cast("string").alias("value"))
    end = end_id.to_bytes(width, "little").decode("latin-1")
    raw.write.options(encoding="ISO-8859-1", lineSep=end, maxRecordsPerFile=FILE_ROWS).text(folder)


def written_places(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, shard, doc_no)``: where ``write_flat`` puts each document, for ids beside the counts.

    ``shard`` is the number in a file's name. It is read off the partitions of ``docs``, so
    these have to be the same in both plans, as those of files and written tables are.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select(id_col, F.spark_partition_id().cast("bigint").alias("shard"), place.alias("doc_no"))


def block_ends(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = 1 << 18) -> DataFrame:
    """``(file, block, n, ends)``: ids in a block, and where in it the end id stands."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if len(data) % width:
                    raise ValueError(f"{file} does not hold whole ids")
                ids = np.frombuffer(data, kind)
                for number, at in enumerate(range(0, len(ids), block)):
                    part = ids[at:at + block]
                    found = np.flatnonzero(part == end_id).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([number], pa.int64()), pa.array([len(part)], pa.int64()),
                         pa.array([found], pa.list_(pa.int32()))], names=["file", "block", "n", "ends"])

    # an empty folder has no files to take a schema from, so none is asked of it
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(search, "file string, block bigint, n bigint, ends array<int>")


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = 1 << 18,
                 joined: bool = False) -> DataFrame:
    """``(file, doc_no, start, n_tokens, ended)``: one row per document, in file order.

    ``start`` is the place of its first id, ``n_tokens`` its ids without the end id;
    two end ids in a row are an empty document. Ids after the last end id are a
    document with ``ended`` false. An empty file has no documents. The result does
    not depend on ``block``. A file is one row of the reader, so it has to stay under
    its limit of 2 GB; ``write_flat`` cuts them well below that. With ``joined`` the files that
    it wrote of one partition are one, end to end in their order, under the name they share.
    """
    blocks = block_ends(spark, folder, end_id, width, block).withColumn("_part", F.lit(0))
    if joined:
        number = F.regexp_extract("file", PART_NUMBER, 1)
        blocks = blocks.withColumn("_part", F.when(number != "", number.cast("int")).otherwise(0)).withColumn(
            "file", F.regexp_replace("file", PART_NUMBER, ""))
    order = Window.partitionBy("file").orderBy("_part", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("base")
    final = F.when(F.size("ends") > 0, base + F.element_at("ends", -1))
    placed = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    scanned = placed.withColumn("_final", final).select(
        "file", "ends", "base", (base + F.col("n")).alias("limit"), "_final",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max("_final").over(before), F.lit(-1)).alias("previous"),
        F.lead("block").over(order).isNull().alias("closing"),
    )
    # ends in this block, in places of the file; the block that closes the file adds an open end
    tail = F.coalesce("_final", "previous")
    ends = F.transform("ends", lambda e: F.struct((F.col("base") + e).alias("at"), F.lit(True).alias("ended")))
    rest = F.array(F.struct(F.col("limit").alias("at"), F.lit(False).alias("ended")))
    ends = F.when(F.col("closing") & (F.col("limit") > tail + 1), F.concat(ends, rest)).otherwise(ends)
    rows = scanned.withColumn("_ends", ends).select(
        "file", "docs", "previous", "_ends", F.posexplode("_ends").alias("i", "end"))
    earlier = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get(F.col("_ends"), F.col("i") - 1)["at"])
    return rows.select("file", (F.col("docs") + F.col("i")).alias("doc_no"), (earlier + 1).alias("start"),
                       (F.col("end.at") - earlier - 1).alias("n_tokens"), F.col("end.ended").alias("ended"))
