"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarline.session import scratch_dir, ship_package

#: Word separators: blank and the five ASCII control separators (fixed value).
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"


#: Rows of an Arrow batch; here a row holds a whole text.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Let Spark send texts to Python in batches of few rows, so that neither side holds many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later steps neither repeat the work nor
    depend on executors that may be lost."""
    spark = frame.sparkSession
    path = scratch_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def native_words(text: Column) -> Column:
    """Words of a text as an array; empty for null and for texts without words."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(
        F.expr("CAST(array() AS array<string>)")
    )


def blocks(texts: Sequence[str], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``most_chars`` characters; a longer text is alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most_chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_blocks(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, past, texts) of consecutive ranges of an Arrow column; only one range at a time is
    made into Python texts. A text of more than ``most_bytes`` is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes), column.slice(start).to_pylist()


def release() -> None:
    """Give the free memory of a Python worker back to the system: Spark keeps workers for later
    tasks, and what one stage needed at its peak would stand beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on a task's batches, with :func:`release` at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def bound_rows(frame: DataFrame, order: Sequence[Column], rows: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``rows`` rows, per value of ``by`` if given, the first by ``order``.

    Spark keeps only that many rows per task before it shuffles them.
    """
    if not by:
        return frame.orderBy(*order).limit(rows)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("__rank", rank).where(F.col("__rank") <= rows).drop("__rank")
