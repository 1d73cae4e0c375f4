"""Batch ingestion: files in, stored readings and statistics per file out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sugarline.operators.statistics import glycemic_statistics
from sugarline.session import remove, scratch_dir
from sugarline.sources import csv_export, json_docs, readings_store

NO_READINGS = "no valid readings"


class Staged:
    """Tables that are computed from staged rows, which ``close`` (or the end of a ``with``) removes."""

    rejected: DataFrame
    staged: str

    def close(self) -> None:
        remove(self.rejected.sparkSession, self.staged)

    def __enter__(self):
        return self

    def __exit__(self, *error) -> None:
        self.close()


@dataclass
class IngestResult(Staged):
    """``results`` has a row per accepted source, ``rejected`` one per source without readings,
    ``counts`` the number of readings per source; ``tallies``, for CSV, the rows of each outcome."""

    readings_saved: int
    results: DataFrame
    rejected: DataFrame
    counts: DataFrame
    staged: str
    tallies: DataFrame | None = None


@dataclass
class CsvStatistics(Staged):
    """``statistics`` has a row per accepted file, ``rejected`` one per other, ``tallies`` the rows
    of each outcome."""

    statistics: DataFrame
    rejected: DataFrame
    tallies: DataFrame
    staged: str


def reject_empty_input(sources: DataFrame, readings: DataFrame) -> DataFrame:
    """Sources that gave no valid reading."""
    accepted = readings.select("source").distinct()
    return sources.join(accepted, "source", "left_anti").withColumn("reason", F.lit(NO_READINGS))


def reject_sources(sources: DataFrame, tallies: DataFrame) -> DataFrame:
    """Sources without a reading and why: what is wrong with all of it, or that no row was valid."""
    counted = sources.join(tallies.select("source", "readings", "source_error"), "source", "left")
    empty = counted.where(F.coalesce("readings", F.lit(0)) == 0)
    return empty.select("source", F.coalesce("source_error", F.lit(NO_READINGS)).alias("reason"))


def ingest_counts(readings: DataFrame) -> DataFrame:
    """Readings handed in per source."""
    return readings.groupBy("source").agg(F.count(F.lit(1)).alias("readings_saved"))


def ingest_statistics(readings: DataFrame) -> DataFrame:
    """Status, number of readings and their statistics per source."""
    stats = glycemic_statistics(readings, "source").withColumnRenamed("count", "readings_saved")
    rest = [c for c in stats.columns if c not in ("source", "readings_saved")]
    return stats.select("source", F.lit("success").alias("status"), "readings_saved", *rest)


def ingest(
    readings: DataFrame, sources: DataFrame, store_path: str, ingest_seq: int | None = None
) -> IngestResult:
    """Store parsed readings and report on them.

    The parsed rows are needed three times. They are written once to the shared scratch folder
    and read back, so that the text is parsed once and a lost executor costs no re-parsing.
    """
    spark = readings.sparkSession
    staged_path = scratch_dir(spark, "parsed")
    readings.write.parquet(staged_path)
    staged = spark.read.schema(readings.schema).parquet(staged_path)
    readings_store.write_readings(staged, store_path, ingest_seq)
    # The number comes from the footers of what was staged, which no repeated task can change
    return IngestResult(
        staged.count(),
        ingest_statistics(staged),
        reject_empty_input(sources, staged),
        ingest_counts(staged),
        staged_path,
    )


def _csv_rows(spark: SparkSession, path: str, in_parts: bool, in_pieces: bool) -> tuple[DataFrame, DataFrame, str]:
    """Sources, and all rows with their outcome as staged: the text is parsed in one pass, whose
    table gives readings, tallies and rejections."""
    if in_pieces:
        lines, sources = csv_export.read_piece_lines(spark, path), csv_export.read_piece_sources(spark, path)
    elif in_parts:
        lines, sources = csv_export.read_part_lines(spark, path), csv_export.read_part_sources(spark, path)
    else:
        lines, sources = csv_export.read_lines(spark, path), csv_export.read_sources(spark, path)
    staged_path = scratch_dir(spark, "parsed")
    rows = csv_export.row_outcomes(lines).withColumn("subject_id", csv_export.file_stem(F.col("source")))
    rows.write.parquet(staged_path)
    return sources, spark.read.schema(rows.schema).parquet(staged_path), staged_path


def ingest_csv(
    spark: SparkSession,
    path: str,
    store_path: str,
    ingest_seq: int | None = None,
    in_parts: bool = False,
    in_pieces: bool = False,
) -> IngestResult:
    """Store the readings of a folder's CSV files and report on them.

    ``in_parts``: each export is a folder of part files, as jobs write them. ``in_pieces``: the
    folder is a table of pieces.
    """
    sources, rows, staged_path = _csv_rows(spark, path, in_parts, in_pieces)
    readings = rows.where(F.col("outcome") == csv_export.READING)
    readings_store.write_readings(readings, store_path, ingest_seq)
    tallies = csv_export.tally(rows)
    return IngestResult(
        readings.count(),
        ingest_statistics(readings),
        reject_sources(sources, tallies),
        ingest_counts(readings),
        staged_path,
        tallies,
    )


def csv_statistics(spark: SparkSession, path: str, in_parts: bool = False, in_pieces: bool = False) -> CsvStatistics:
    """Statistics per CSV file and the files without a valid reading; nothing is stored."""
    sources, rows, staged_path = _csv_rows(spark, path, in_parts, in_pieces)
    readings, tallies = rows.where(F.col("outcome") == csv_export.READING), csv_export.tally(rows)
    return CsvStatistics(glycemic_statistics(readings, "source"), reject_sources(sources, tallies), tallies, staged_path)


def ingest_json(
    spark: SparkSession,
    path: str,
    store_path: str,
    subject: str | Column,
    ingest_seq: int | None = None,
    in_parts: bool = False,
    in_pieces: bool = False,
) -> IngestResult:
    """``subject`` is one subject's id, or an expression over ``source`` for a folder of many.

    ``in_parts``: each document is a folder of part files, as jobs write them. ``in_pieces``: the
    folder is a table of pieces.
    """
    subject = F.lit(subject) if isinstance(subject, str) else subject
    readings = json_docs.read_cgm_json(spark, path, in_parts, in_pieces).withColumn("subject_id", subject)
    return ingest(readings, json_docs.read_sources(spark, path, in_parts, in_pieces), store_path, ingest_seq)
