"""Vendor JSON documents: ``{"sgs": [{"timestamp": <epoch ms>, "sg": <number>}, ...]}``.

Files are read in byte ranges (see ``json_ranges``); streams and documents held as text as a whole.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from sugarline import constants as C
from sugarline.functions import parsing
from sugarline.functions.once import once
from sugarline.session import list_folders
from sugarline.sources import json_ranges, pieces

NUMERIC_TYPE = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def documents(files: DataFrame) -> DataFrame:
    """(source, written_at, text) of a whole-text scan, batch or stream."""
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("written_at"),
        F.col("value").alias("text"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", "*.json")
    return documents(reader.text(path, wholetext=True))


def read_sources(spark: SparkSession, path: str, in_parts: bool = False, in_pieces: bool = False) -> DataFrame:
    """Names of all JSON documents of a folder; contents are not read."""
    if in_pieces:
        return pieces.read_names(spark, path).withColumnRenamed("file_name", "source")
    if in_parts:
        names = [(unquote(f.split("file_name=", 1)[1]),) for f in list_folders(spark, path) if "file_name=" in f]
        return spark.createDataFrame(names, "source string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.col("_metadata.file_path").alias("source"))


def explode_entries(docs: DataFrame) -> DataFrame:
    """One row per entry: type and number of the timestamp, type, text and number of the value.

    Columns of the document other than its text stay.
    """
    kept = [c for c in docs.columns if c != "text"]
    fields = """
        schema_of_variant(p.t) AS ts_type, try_variant_get(p.t, '$', 'double') AS ts_number,
        schema_of_variant(p.v) AS sg_type, try_variant_get(p.v, '$', 'string') AS sg_text,
        try_variant_get(p.v, '$', 'double') AS sg_number"""
    # Each member is looked up once, and before the rows are made: filters above do not repeat it
    members = """struct(try_variant_get(e, '$.timestamp', 'variant') AS t,
        try_variant_get(e, '$.sg', 'variant') AS v)"""
    pairs = f"transform(from_json(text, 'sgs array<variant>').sgs, e -> {members})"
    rows = docs.selectExpr(*kept, f"posexplode({pairs}) AS (pos, pair)")
    return rows.selectExpr(
        *kept, "CAST(pos AS BIGINT) AS pos", f"inline(transform(array(pair), p -> struct({fields})))"
    )


def parse_entries(entries: DataFrame) -> DataFrame:
    """The same columns as :func:`explode_entries`, from entries held as text."""
    kept = [c for c in entries.columns if c != "entry"]
    # The lambdas bind the entry, so that it is parsed once
    members = """struct(try_variant_get(e, '$.timestamp', 'variant') AS t,
        try_variant_get(e, '$.sg', 'variant') AS v)"""
    pair = f"transform(array(try_parse_json(entry)), e -> {members})"
    fields = """
        schema_of_variant(p.t) AS ts_type, try_variant_get(p.t, '$', 'double') AS ts_number,
        schema_of_variant(p.v) AS sg_type, try_variant_get(p.v, '$', 'string') AS sg_text,
        try_variant_get(p.v, '$', 'double') AS sg_number"""
    return entries.selectExpr(*kept, f"inline(transform({pair}, p -> struct({fields})))")


def drop_empty_json(entries: DataFrame) -> DataFrame:
    """Entries whose timestamp is a number other than 0 and whose value is neither 0 nor empty.

    A quoted timestamp counts as unusable, a quoted value does not.
    """
    quoted = F.col("sg_type") == "STRING"
    value = F.when(quoted, parsing.parse_number(F.col("sg_text"))).otherwise(F.col("sg_number"))
    kept = [c for c in entries.columns if c not in ("ts_type", "sg_type", "sg_text", "sg_number")]
    return (
        entries.where(F.col("ts_type").rlike(NUMERIC_TYPE) & (F.col("ts_number") != 0))
        .where(F.when(quoted, F.col("sg_text") != "").otherwise(F.col("sg_number") != 0))
        .select(*kept, once(glucose_mg_dl=value))
    )


def drop_nonpositive(readings: DataFrame, value: str = "glucose_mg_dl") -> DataFrame:
    return readings.where(F.col(value) > 0)


def parse_documents(docs: DataFrame) -> DataFrame:
    """Readings: the document's columns but its text, pos, ts, glucose_mg_dl, units.

    Bad entries and documents give none.
    """
    return _readings(explode_entries(docs))


def _readings(entries: DataFrame) -> DataFrame:
    valid = drop_nonpositive(drop_empty_json(entries))
    kept = [c for c in valid.columns if c != "ts_number"]
    timed = valid.select(*kept, once(ts=parsing.epoch_ms_to_ts(F.col("ts_number"))))
    return timed.where(F.col("ts").isNotNull()).withColumn("units", F.lit(C.UNITS))


def read_cgm_json(spark: SparkSession, path: str, in_parts: bool = False, in_pieces: bool = False) -> DataFrame:
    """Readings of all JSON documents of a folder; one of any size is read by many tasks.

    ``in_parts``: each document is a folder ``file_name=<name>`` of part files, as jobs write them.
    ``in_pieces``: the folder is a table of pieces. ``pos`` ascends through the document.
    """
    if in_pieces:
        records = json_ranges.read_piece_records(spark, path)
    else:
        records = json_ranges.read_part_records(spark, path) if in_parts else json_ranges.read_records(spark, path)
    return _readings(parse_entries(json_ranges.entries(records)))
