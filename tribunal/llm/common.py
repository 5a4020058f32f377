"""Helpers shared by the training-data operators: tables, shared staging, compressed text."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: doc_id of rows whose doc_id is null, inside operators that join on it. It is larger than any other; a doc_id that is equal to it counts as null.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or (tests on one machine) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's setting to delete the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaning(spark: SparkSession):
    """What is shuffled for an action goes as it ends, so that stages don't add up on disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before or "false")


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    with cleaning(df.sparkSession):
        df.write.mode(mode).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors. The folder is added to `folders`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    if folders is not None:
        folders.append(path)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A list for `staged`, whose folders go at the end."""
    folders: list[str] = []
    try:
        yield folders
    finally:
        remove(spark, *folders)


def give_back() -> None:
    """Return what a worker has freed to the system: else it stays with the worker, beside all later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # there with glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, for mapInArrow, but its worker gives back what it freed when the task is done."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only (other columns can't clash); a null doc_id becomes NULL_ID."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def real_id(col: str = "doc_id"):
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias(col)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and n + 1 offsets into them. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = 1 << 20):
    """Cut the rows into runs of about `most` bytes (one row at least): pairs of row numbers."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def compressed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_bytes, z) and more columns (long): each whole text zstd-compressed by itself, so that moving it costs less than the input."""

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, off = utf8(b.column("text"))
            raw = memoryview(data)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off)), pa.array([z.compress(raw[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)], pa.binary()), *map(b.column, more)],
                ["doc_id", "n_bytes", "z", *more],
            )

    return docs.select("doc_id", "text", *more).mapInArrow(pack, ", ".join(["doc_id long, n_bytes long, z binary", *[f"{c} long" for c in more]]))


def decompressed(column: pa.Array) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) if x is not None else b"" for x in column.to_pylist()]
