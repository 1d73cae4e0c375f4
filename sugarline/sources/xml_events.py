"""Event files: one XML document per subject and split, four streams, values in attributes.

Files are read in byte ranges (see ``xml_ranges``), documents held as text as a whole. A document is
parsed once; its streams leave as one long table

    subject_id, stream, ts, value, detail, pos

with the bolus type as ``detail`` and the position inside the stream as ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sugarline.functions import parsing
from sugarline.functions.once import once
from sugarline.operators.timeline import BASAL, BOLUS, GLUCOSE, MEAL, filter_series
from sugarline.session import list_folders
from sugarline.sources import pieces, xml_ranges

ATTRIBUTES = {
    "glucose_level": ("_ts", "_value"),
    "bolus": ("_ts_begin", "_ts", "_dose", "_type"),
    "basal": ("_ts", "_value"),
    "meal": ("_ts", "_carbs"),
}
SCHEMA = ", ".join(
    f"{stream} array<struct<event:array<struct<{','.join(f'{a}:string' for a in names)}>>>>"
    for stream, names in ATTRIBUTES.items()
)
FILE_PATTERN = "*-ws-{split}.xml"


def subject_of(file_name: Column) -> Column:
    """Subject id: the file stem before its first dash."""
    return F.split_part(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.lit("-"), F.lit(1))


def in_split(file_name: Column, split: str) -> Column:
    return file_name.endswith(f"-ws-{split}.xml")


def discover_split_files(
    spark: SparkSession, raw_dir: str, split: str, in_parts: bool = False, in_pieces: bool = False
) -> DataFrame:
    """Files of the split with their subject, in name order; contents are not read.

    ``in_parts``: each document is a folder ``file_name=<name>`` of part files, as jobs write them.
    ``in_pieces``: the folder is a table of pieces, and stands as the path.
    """
    if in_pieces:
        names = pieces.read_names(spark, raw_dir).where(in_split(F.col("file_name"), split))
        files = names.select(F.lit(raw_dir).alias("path"), "file_name")
    elif in_parts:
        found = [(f, f.split("file_name=", 1)[1]) for f in list_folders(spark, raw_dir) if "file_name=" in f]
        files = spark.createDataFrame(found, "path string, file_name string")
        files = files.where(in_split(F.col("file_name"), split))
    else:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", FILE_PATTERN.format(split=split))
            .load(raw_dir)
            .select(F.col("path"), F.col("_metadata.file_name").alias("file_name"))
        )
    return files.withColumn("subject_id", subject_of(F.col("file_name"))).orderBy("file_name")


def split_files_exist(spark: SparkSession, raw_dir: str, split: str) -> bool:
    return not discover_split_files(spark, raw_dir, split).isEmpty()


def parse_xml_texts(docs: DataFrame, by_file: bool = False) -> DataFrame:
    """Documents held as (file_name, text) rows; the root element may have any name.

    With ``by_file`` the file's name stands for the subject, so that files stay apart.
    """
    name = F.col("file_name")
    parsed = docs.select(
        (name if by_file else subject_of(name)).alias("subject_id"),
        F.from_xml("text", SCHEMA).alias("doc"),
    )
    return explode_streams(parsed.select("subject_id", "doc.*"))


def read_split(
    spark: SparkSession, raw_dir: str, split: str, by_file: bool = False, in_parts: bool = False, in_pieces: bool = False
) -> DataFrame:
    """Events of all subjects of a split; empty when no file matches.

    A file of any size is read by many tasks. ``pos`` ascends through the document.
    """
    if in_pieces:
        records = xml_ranges.read_piece_records(spark, raw_dir, f"-ws-{split}.xml")
    elif in_parts:
        records = xml_ranges.read_part_records(spark, raw_dir, f"-ws-{split}.xml")
    else:
        records = xml_ranges.read_records(spark, raw_dir, FILE_PATTERN.format(split=split))
    return events_of(xml_ranges.elements(records), by_file)


def events_of(elements: DataFrame, by_file: bool = False) -> DataFrame:
    """Events among elements (source, row, parent, tag): those whose parent is one of the streams."""
    names = [a[1:] for a in dict.fromkeys(a for own in ATTRIBUTES.values() for a in own)]
    streams = {"glucose_level": GLUCOSE, "bolus": BOLUS, "basal": BASAL, "meal": MEAL}
    wanted = elements.where(F.col("parent").isin(*streams))
    e = wanted.select("source", "row", "parent", F.inline(F.array(xml_ranges.attributes(F.col("tag"), *names))))
    is_bolus = F.col("parent") == "bolus"
    stream = F.coalesce(*[F.when(F.col("parent") == tag, F.lit(name)) for tag, name in streams.items()])
    value = F.when(is_bolus, F.col("dose")).when(F.col("parent") == "meal", F.col("carbs")).otherwise(F.col("value"))
    rows = e.select(
        (F.col("source") if by_file else subject_of(F.col("source"))).alias("subject_id"),
        stream.alias("stream"),
        F.when(is_bolus, parsing.coalesce_bolus_ts(F.col("ts_begin"), F.col("ts"))).otherwise(F.col("ts")).alias("ts_text"),
        value.alias("value_text"),
        F.when(is_bolus, parsing.default_bolus_type(F.col("type"))).alias("detail"),
        F.col("row").alias("pos"),
    )
    return parsed_events(drop_missing_attr(rows))


def raw_events(rows: DataFrame) -> DataFrame:
    """All events as text: subject_id, stream, ts_text, value_text, detail, pos."""

    def stream(tag: str, name: str, fields) -> Column:
        events = F.flatten(F.filter(F.transform(tag, lambda s: s["event"]), F.isnotnull))

        def to_row(event: Column, position: Column) -> Column:
            ts, value, detail = fields(event)
            return F.struct(
                F.lit(name).alias("stream"),
                ts.alias("ts_text"),
                value.alias("value_text"),
                detail.alias("detail"),
                position.cast("bigint").alias("pos"),
            )

        empty = F.array().cast(
            "array<struct<stream:string,ts_text:string,value_text:string,detail:string,pos:bigint>>"
        )
        return F.coalesce(F.transform(events, to_row), empty)

    nothing = F.lit(None).cast("string")
    streams = F.concat(
        stream("glucose_level", GLUCOSE, lambda e: (e["_ts"], e["_value"], nothing)),
        stream(
            "bolus",
            BOLUS,
            lambda e: (
                parsing.coalesce_bolus_ts(e["_ts_begin"], e["_ts"]),
                e["_dose"],
                parsing.default_bolus_type(e["_type"]),
            ),
        ),
        stream("basal", BASAL, lambda e: (e["_ts"], e["_value"], nothing)),
        stream("meal", MEAL, lambda e: (e["_ts"], e["_carbs"], nothing)),
    )
    return rows.select("subject_id", F.inline(streams))


def drop_missing_attr(events: DataFrame) -> DataFrame:
    """Events with both a time and a value, neither empty."""
    return events.where((F.col("ts_text") != "") & (F.col("value_text") != ""))


def explode_streams(rows: DataFrame) -> DataFrame:
    return parsed_events(drop_missing_attr(raw_events(rows)))


def parsed_events(rows: DataFrame) -> DataFrame:
    events = rows.select(
        "subject_id",
        "stream",
        "detail",
        "pos",
        once(
            ts=parsing.parse_xml_ts(F.col("ts_text")),
            value=parsing.parse_number(F.col("value_text")),
        ),
    )
    return events.where(F.col("ts").isNotNull() & F.col("value").isNotNull())


def _stream(events: DataFrame, name: str, value: str, *more: Column) -> DataFrame:
    return filter_series(events, name).select(
        "subject_id", F.col("ts").alias("timestamp"), F.col("value").alias(value), *more
    )


def glucose_events(events: DataFrame) -> DataFrame:
    return _stream(events, GLUCOSE, "glucose_mg_dl")


def bolus_events(events: DataFrame) -> DataFrame:
    return _stream(events, BOLUS, "bolus_dose_u", F.col("detail").alias("bolus_type"))


def basal_events(events: DataFrame) -> DataFrame:
    return _stream(events, BASAL, "basal_rate_u_hr")


def meal_events(events: DataFrame) -> DataFrame:
    return _stream(events, MEAL, "carbs_g")
