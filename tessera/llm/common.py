"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured and all run on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths written since each open block of temporary() began, the innermost last; every thread and context has its own.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables materialised inside are deleted at the end: what is needed later must have been written as an outer one by then."""
    mine: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for path in mine:
            delete(spark, path)


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    outer: the table is needed after the innermost block of temporary(), and belongs to the one around it.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(f"{folder}/{name}")
    scopes = _SCOPES.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(folder)
    table = spark.read.schema(schema).parquet(f"{folder}/{name}")
    table.written_to = folder
    return table


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing needs any more."""
    delete(table.sparkSession, table.written_to)


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few MB: texts are long, and the default is by ten thousand rows."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")):
        spark.conf.set(key, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a few numbers or short strings that are told to every task; more are shuffled.
TOLD_ROWS = 1_000_000
#: A group is hot when it has more rows than a task's share of all rows over this, and more than so many.
HOT_PARTS, HOT_ROWS = 4, 1000


def told(df: DataFrame, most: int = TOLD_ROWS) -> DataFrame:
    """df, to be broadcast in a join if it has at most so many rows. df is counted: it should be a written table."""
    return F.broadcast(df) if df.count() <= most else df


def hot_limit(spark: SparkSession, total: int) -> int:
    """Groups of more rows than this are hot: there are few of them, at most total over it."""
    return max(1, HOT_ROWS, total // (HOT_PARTS * shuffle_partitions(spark)))


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows with the columns of their group (inner join on columns without nulls); size: the column of groups with their number of rows.

    Groups of more than a small share of all rows are few, so they are told to every task and their rows stay where they
    are: no task takes a hot group. The others are joined by a shuffle. groups is read twice.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = hot_limit(rows.sparkSession, total)
    hot = groups.where(F.col(size) > limit)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col(size) <= limit), on)
    return cold.unionByName(rows.join(F.broadcast(hot), on).select(*cold.columns))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with the columns that clash with names (case-insensitively) renamed by underscores before their names."""
    names = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, free_name(df, f"_{c}"))
    return df


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (len + 1) of an Arrow string column, without copying; null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system: a reused worker would hold on to its peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def split_batches(batches, max_bytes: int = 8_000_000, column: str = "text"):
    """Cut record batches so that each holds about max_bytes of text at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        _, off = text_buffers(batch.column(i))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
