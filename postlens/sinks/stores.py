"""Writing results: files, relational rows, document rows, dispatch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from postlens.constants import SNAPSHOT_STAMP, STORE_DATABASE, STORE_TABLE

FORMATS = ("json", "csv", "parquet", "jdbc", "postgres", "mongodb")


def stamp(at: datetime | None = None) -> str:
    return (at or datetime.now()).strftime(SNAPSHOT_STAMP)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON array per partition: of objects, or of texts where there is one string column."""
    value = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append("[" if held is None else held + ",")
                held = text
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if held is None else [held, "]"], pa.string())], ["value"])

    if [f.dataType for f in df.schema.fields] == [T.StringType()]:
        # a list of texts: the value of the only field
        whole = F.to_json(F.array(F.col(f"`{df.columns[0]}`")))
        value = F.substr(whole, F.lit(2), F.length(whole) - 2)
    df.select(value.alias("value")).mapInArrow(arrays, "value string").write.mode(mode).text(path)
    return path


def write_snapshot(df: DataFrame, base: str, at: datetime | None = None, prefix: str = "jobs") -> str:
    """A JSON folder named by the time of writing."""
    return write_json(df, f"{base.rstrip('/')}/{prefix}_{stamp(at)}", mode="errorifexists")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats of flat values."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header; quotes are doubled so any text reads back."""
    flat(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    return path


def read_csv(spark, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("multiLine", True).csv(path)
    )


def records_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Every row as one JSON record; null fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def _or_default(df: DataFrame, name: str, default) -> Column:
    """A column with nulls filled, or the default where the table lacks it."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def store_rows(df: DataFrame, at: datetime | Column, metadata_json: bool = True) -> DataFrame:
    """Rows of the result store: defaults filled and one time for the batch."""
    # spelled out, so the time does not move with the time zone of session or driver
    when = at if isinstance(at, Column) else F.lit(at.isoformat(sep=" "))
    if "metadata" in df.columns:
        metadata = F.coalesce(F.to_json("metadata"), F.lit("{}")) if metadata_json else F.col("metadata")
    else:
        metadata = F.lit("{}") if metadata_json else F.lit(None).cast("map<string,string>")
    return df.select(
        _or_default(df, "description", "").alias("description"),
        _or_default(df, "category", "").alias("category"),
        _or_default(df, "confidence", 0.0).cast("double").alias("confidence"),
        when.cast("timestamp_ntz").alias("timestamp"),
        metadata.alias("metadata"),
    )


def jdbc_options(url: str | None, table: str = STORE_TABLE, **more: str) -> dict[str, str]:
    """Writer options; the table is made when absent and rows are appended.

    Column types of a new table are the dialect's own for text, double and timestamp.
    Untyped strings let an existing table hold the metadata as JSONB and number its
    rows by itself.
    """
    if not url:
        raise ValueError("a JDBC url is required")
    typing = {"stringtype": "unspecified"} if url.startswith("jdbc:postgresql:") else {}
    return {"url": url, "dbtable": table, **typing, **more}


def mongo_options(uri: str | None, database: str = STORE_DATABASE, collection: str = STORE_TABLE,
                  **more: str) -> dict[str, str]:
    if not uri:
        raise ValueError("a document store uri is required")
    return {"connection.uri": uri, "database": database, "collection": collection, **more}


def counted_write(df: DataFrame, write: Callable[[DataFrame], None], **measures: Column) -> dict:
    """Run ``write`` on ``df`` and return ``rows`` and the ``measures`` (aggregates) of what it wrote.

    They are observed on the rows on their way, so the plan runs once. ``write`` has to
    run ``df`` exactly once.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()]))
    return seen.get


def _moved(df: DataFrame, source: str, target: str | None) -> None:
    """Put a written folder in the place of ``target``, or remove it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if target is None:
        files.delete(path(source), True)
        return
    files.delete(path(target), True)
    if not files.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def save(df: DataFrame, kind: str, at: datetime | None = None, **options: str) -> bool:
    """Write by kind; an unknown kind raises. Nothing is written for no rows.

    Returns whether rows were written. Files are written beside their place, counted on
    the way, and moved there only if there were rows; the plan runs once, and what stood
    there stays if there were none. JDBC and document writes go partition by partition
    from the executors; they would make their table for no rows too, so these are asked first.
    """
    if kind not in FORMATS:
        raise ValueError(f"unsupported store {kind!r}, use one of {', '.join(FORMATS)}")
    if kind in ("json", "csv", "parquet"):
        target = options["path"].rstrip("/")
        if kind == "json":
            target = f"{target}/jobs_{stamp(at)}"
        writers = {"json": write_json, "csv": write_csv, "parquet": lambda rows, path: rows.write.parquet(path)}
        beside = f"{target}.{uuid.uuid4().hex}"
        written = counted_write(df, lambda rows: writers[kind](rows, beside))["rows"] > 0
        _moved(df, beside, target if written else None)
        return written
    if df.isEmpty():
        return False
    if kind in ("jdbc", "postgres"):
        rows = store_rows(df, at or datetime.now())
        rows.write.format("jdbc").mode("append").options(**jdbc_options(**options)).save()
    else:
        rows = df.withColumn("timestamp", F.lit(at or datetime.now()))
        rows.write.format("mongodb").mode("append").options(**mongo_options(**options)).save()
    return True
