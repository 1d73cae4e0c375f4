"""Documents kept as rows of a Parquet folder: file_name, written_at, part, text.

Many small documents share a file, so the number of files follows the bytes, not the documents; a
large document is many rows, which many tasks read. Its pieces in the order of ``part`` are its text.
A piece has less than 2^24 bytes and ends between two lines, entries or tags. A document of no byte
is a row without text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "file_name string, written_at timestamp, part bigint, text string"
#: 2^10 lines at most make a piece.
LINES_BITS = 10


def write_pieces(lines: DataFrame, path: str, empty: Sequence[str] = ()) -> None:
    """Write (file_name, pos, line) rows, each document's in the order of ``pos``, and the documents
    of no byte. Ranges of (file_name, pos) are dealt over the tasks: a name of any size has many pieces."""
    dealt = lines.repartitionByRange("file_name", "pos").sortWithinPartitions("file_name", "pos")
    line = F.concat(F.coalesce("line", F.lit("")), F.lit("\n"))
    # Numbers ascend through the sorted ranges
    numbered = dealt.select("file_name", F.monotonically_increasing_id().alias("at"), line.alias("line"))
    numbered = numbered.withColumn("part", F.shiftright("at", LINES_BITS))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "")
    made = numbered.groupBy("file_name", "part").agg(text.alias("text"))
    nothing = lines.sparkSession.createDataFrame([(name, 0, "") for name in empty], "file_name string, part bigint, text string")
    made = made.unionByName(nothing).select("file_name", F.current_timestamp().alias("written_at"), "part", "text")
    made.write.parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of all documents, those of no byte too (``file_name``); texts are not read."""
    return read_pieces(spark, path).select("file_name").distinct()


def block() -> Column:
    """A piece as a block of its document; larger by the bytes of the piece before, at least."""
    return F.shiftleft("part", 24)
