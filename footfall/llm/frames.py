"""What the operators share: reading tables, Arrow batches of bounded size, stored intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import shared_folder

# Rows and bytes of text that a Python worker holds as objects at a time.
SLICE_ROWS = 2_000
SLICE_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts be a few MB; Spark's 64 MB, times buffers and workers, crowd small executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text as UTF-8 bytes, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of a bounded number of rows and, but for one long row, of bytes."""
    for batch in batches:
        start, rows = 0, batch.num_rows
        while start < rows:
            count = min(SLICE_ROWS, rows - start)
            piece = batch.slice(start, count)
            while count > 1 and piece.nbytes > SLICE_BYTES:
                count = max(1, count // 2)
                piece = batch.slice(start, count)
            yield piece
            start += count
        batch = piece = None
    give_back()


def give_back() -> None:
    """Return freed memory to the system; a worker otherwise keeps its peak while it waits for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def keep_freed() -> None:
    """Let the C library reuse freed memory for large arrays, which it else maps anew, page by page; ``give_back`` still returns it."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except AttributeError:
        pass


def fold_bucket(id_col: str | Column, parts: int = 5) -> Column:
    """crc32 of the id's text modulo ``parts``; NULL for a NULL id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


def tasks(spark: SparkSession) -> int:
    """Partitions for exchanges whose number must be given: as many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
