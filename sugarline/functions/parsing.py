"""Cell parsers. A value that does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sugarline.constants import SENTINELS

WHITESPACE = " \t\n\r\x0b\x0c"
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
CSV_TIME = r"^(?!0000)\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
XML_TIME = r"^\d{1,2}-\d{1,2}-(?!0000)\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"

# Epoch milliseconds of years 1 to 9999
EPOCH_MS_RANGE = (-62135596800000.0, 253402300799999.0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def parse_number(text: Column) -> Column:
    """Finite decimal number. The pattern guards ``try_cast``, which reads '12d' as 12."""
    text = strip(text)
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def decode_sentinel(cell: Column) -> Column:
    """Glucose cell: a sentinel word or a number."""
    text = strip(cell)
    decoded = parse_number(text)
    for word, value in SENTINELS.items():
        decoded = F.when(text == word, F.lit(value)).otherwise(decoded)
    return decoded


def _parse_time(text: Column, guard: str, pattern: str) -> Column:
    return F.when(
        text.rlike(guard), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    )


def parse_csv_ts(date: Column, time: Column) -> Column:
    text = F.concat(strip(date), F.lit(" "), strip(time))
    return _parse_time(text, CSV_TIME, "yyyy/M/d H:m:s")


def parse_xml_ts(text: Column) -> Column:
    return _parse_time(text, XML_TIME, "d-M-yyyy H:m:s")


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds to UTC wall-clock time without a zone."""
    micros = F.rint(ms * 1000.0).cast("bigint")
    return F.when(
        ms.between(*EPOCH_MS_RANGE), F.timestamp_micros(micros).cast("timestamp_ntz")
    )


def coalesce_bolus_ts(ts_begin: Column, ts: Column) -> Column:
    return F.coalesce(F.nullif(ts_begin, F.lit("")), ts)


def default_bolus_type(bolus_type: Column) -> Column:
    """``normal`` when the attribute is missing; an empty one stays empty."""
    return F.coalesce(bolus_type, F.lit("normal"))
