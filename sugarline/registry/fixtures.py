"""The given tables seen as the library's inputs.

Each view is derived by Spark from whole tables. The ``*_CTE`` strings are the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sugarline.session import scratch_dir
from sugarline.sources.pieces import write_pieces

CADENCE = 6 * 3600
SPLIT_AT = "2024-01-21"
HEADER_FROM = "2024-01-02"
SECOND_HEADER_FROM = "2024-01-16"
#: Lines of five days make a block. Where two blocks meet stands a row that begins in one and ends
#: in the other, the first three below the first header, the others below the second.
BLOCK_MICROS = 5 * 86_400_000_000
EDGES = ("2024-01-03", "2024-01-08", "2024-01-13", "2024-01-18", "2024-01-23", "2024-01-28")
EDGE_VALUE = 111


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def is_type(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def subject() -> Column:
    return F.col("user_id").cast("string").alias("subject_id")


def hour() -> Column:
    return F.date_trunc("hour", "ts").cast("timestamp_ntz")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        subject(),
        "ts",
        F.col("value").alias("glucose_mg_dl"),
        F.col("event_id").alias("pos"),
        "event_type",
    )


READINGS_CTE = """readings AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, ts, value AS glucose_mg_dl, event_id AS pos,
         event_type
  FROM events)"""


def stream_name() -> Column:
    return (
        F.when(is_type("view", "error"), "glucose")
        .when(is_type("purchase"), "bolus")
        .when(is_type("click"), "basal")
        .when(is_type("signup"), "meal")
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.when(is_type("purchase", "click"), F.col("value") / 50).otherwise(F.col("value"))
    return events(spark, sf_dir).select(
        subject(),
        stream_name().alias("stream"),
        "ts",
        scaled.alias("value"),
        F.col("event_id").alias("pos"),
    )


STREAMS_CTE = """streams AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, ts, event_id AS pos,
         CASE WHEN event_type IN ('view', 'error') THEN 'glucose'
              WHEN event_type = 'purchase' THEN 'bolus'
              WHEN event_type = 'click' THEN 'basal'
              WHEN event_type = 'signup' THEN 'meal' END AS stream,
         CASE WHEN event_type IN ('purchase', 'click') THEN value / 50 ELSE value END AS value
  FROM events)"""


def by_split(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "split", F.when(F.col("ts") < ntz(SPLIT_AT), "training").otherwise("testing")
    )


# --- files ----------------------------------------------------------------------------------


def write_files(lines: DataFrame, label: str, *empty: str) -> str:
    """Write (file_name, pos, line) rows as documents in pieces, and documents of no byte, in a new
    shared folder; its path."""
    folder = scratch_dir(lines.sparkSession, label)
    write_pieces(lines, folder, empty)
    return folder


# --- CSV lines ------------------------------------------------------------------------------


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of preamble, a header from day two, another layout from day sixteen; five days
    per block.

    Lines of day one stand above the header. ``error`` rows hold no number, ``signup`` rows a
    blank, ``purchase`` rows end before the last cell; extreme values are sentinels. ``view`` rows
    have a line break in a quoted cell. The rows at the edges hold a header line inside a cell.
    """
    source = F.concat(F.lit("/exports/"), F.col("user_id"), F.lit(".csv"))
    date, time = F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss")
    glucose = (
        F.when(is_type("error"), "not_a_number")
        .when(is_type("signup"), "  ")
        .when(F.col("value") < 5, "Low")
        .when(F.col("value") > 300, "High")
        .otherwise(F.col("value").cast("string"))
    )
    number = F.col("event_id").cast("string")
    broken = is_type("view")
    note = F.when(broken, F.lit('"sensor,\n""A"""')).otherwise(F.lit('"sensor, ""A"""'))
    first = F.concat_ws(
        ",", number, date, time, note, F.when(~is_type("purchase"), glucose)
    )
    quoted = F.when(broken, F.concat(F.lit('"'), number, F.lit('\n"'))).otherwise(number)
    second = F.concat_ws(",", quoted, glucose, time, F.when(~is_type("purchase"), date))
    row = F.when(F.col("ts") < ntz(SECOND_HEADER_FROM), first).otherwise(second)
    data = events(spark, sf_dir).select(
        source.alias("source"),
        (micros(F.col("ts")) * 8 + 4).alias("at"),
        F.posexplode(F.split(row, "\n")).alias("k", "line"),
    ).select("source", (F.col("at") + F.col("k")).alias("pos"), "line")
    header = "Index,Date,Time,BG Source,Sensor Glucose (mg/dL)"
    fixed = [
        (F.lit(0), "Device: sensor"),
        (F.lit(1), "Serial: 1,2,3"),
        (micros(ntz(HEADER_FROM)) * 8 - 1, header),
        (micros(ntz(SECOND_HEADER_FROM)) * 8 - 1, 'Index,"Sensor Glucose (mg/dL)",Time,Date'),
    ]
    for day in EDGES:
        at, shown = micros(ntz(day)) * 8, day.replace("-", "/")
        if day < SECOND_HEADER_FROM:
            three = [f'0,{shown},00:00:00,"from', header, f'to",{EDGE_VALUE}']
        else:
            three = ['"0', header, f'",{EDGE_VALUE},00:00:00,{shown}']
        fixed += [(at + k - 1, line) for k, line in enumerate(three)]
    rows = [F.struct(at.cast("bigint").alias("pos"), F.lit(line).alias("line")) for at, line in fixed]
    sources = events(spark, sf_dir).select(source.alias("source")).distinct()
    lines = data.unionByName(sources.select("source", F.inline(F.array(*rows))))
    width = F.lit(8 * BLOCK_MICROS)
    block = F.floor(F.col("pos") / width).cast("bigint") * width
    return lines.select("source", block.alias("block"), "pos", "line")


def csv_files(spark: SparkSession, sf_dir: str) -> str:
    """A table of pieces with one export per subject, and four exports without a
    reading: a header alone, a blank line, no byte, and a header that lacks the time."""
    name = F.element_at(F.split("source", "/"), -1).alias("file_name")
    exports = csv_lines(spark, sf_dir).select(name, "pos", "line")
    header = "Index,Date,Time,BG Source,Sensor Glucose (mg/dL)"
    more = [
        ("header.csv", 0, header), ("blank.csv", 0, " "), ("broken.csv", 0, header.replace("Time", "Clock")),
        ("broken.csv", 1, "0,2024/01/01,00:00:00,,100"),
    ]
    return write_files(exports.unionByName(spark.createDataFrame(more, exports.schema)), "exports", "zero.csv")


CSV_CTE = f"""edges AS (SELECT unnest({list(EDGES)}) AS day),
located AS (
  SELECT '/exports/' || user_id || '.csv' AS source, CAST(user_id AS VARCHAR) AS subject_id,
         ts, value, event_type,
         ts >= TIMESTAMP '{HEADER_FROM}' AS below_header,
         ts >= TIMESTAMP '{SECOND_HEADER_FROM}' AS second_layout
  FROM events
  UNION ALL
  SELECT '/exports/' || user_id || '.csv', CAST(user_id AS VARCHAR), CAST(day AS TIMESTAMP), {EDGE_VALUE}, 'edge',
         TRUE, day >= '{SECOND_HEADER_FROM}'
  FROM (SELECT DISTINCT user_id FROM events), edges),
kept AS (
  SELECT *, event_type = 'signup' OR (event_type = 'purchase' AND NOT second_layout) AS blank,
         event_type = 'error' OR (event_type = 'purchase' AND second_layout) AS unparsable
  FROM located WHERE below_header),
csv_readings AS (
  SELECT source, subject_id, date_trunc('second', ts) AS ts,
         CASE WHEN value < 5 THEN 39.0 WHEN value > 300 THEN 401.0 ELSE value END
           AS glucose_mg_dl
  FROM kept WHERE NOT blank AND NOT unparsable)"""


# --- JSON documents -------------------------------------------------------------------------


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event: a usable entry, a quoted value a minute later, and bad entries.

    ``error`` documents are cut off, ``signup`` documents hold no list, ``click`` values are
    lowered by 100, which makes some of them negative.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    shown = F.when(is_type("click"), F.round(F.col("value") - 100, 2)).otherwise(F.col("value"))
    text = F.format_string(
        '{"sgs":[{"timestamp":%1$d,"sg":%2$s},{"timestamp":%3$d,"sg":"%2$s"},'
        '{"timestamp":0,"sg":100},{"timestamp":%1$d,"sg":0},{"sg":5},{"timestamp":%1$d},'
        '{"timestamp":"%1$d","sg":7},{"timestamp":%1$d,"sg":"x"},7,null]}',
        ms,
        shown.cast("string"),
        ms + 60000,
    )
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("source"),
        subject(),
        F.when(is_type("error"), '{"sgs":[{"timestamp":')
        .when(is_type("signup"), '{"sgs":null}')
        .otherwise(text)
        .alias("text"),
    )


def json_files(spark: SparkSession, sf_dir: str) -> str:
    """A table of pieces with one document per subject: the entries of all its events,
    usable and bad ones, in one list; and a document without a list."""
    docs = json_documents(spark, sf_dir).where(F.startswith("text", F.lit('{"sgs":[{"timestamp":')) & F.endswith("text", F.lit("]}")))
    name = F.concat("subject_id", F.lit(".json")).alias("file_name")
    inner = F.expr("substr(text, 9, length(text) - 10)")
    data = docs.select(name, F.col("source").cast("bigint").alias("pos"), F.concat(F.lit(","), inner).alias("line"))
    ends = F.inline(
        F.array(
            F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit('{"other":["}"],"sgs":[null').alias("line")),
            F.struct(F.lit((1 << 63) - 1).alias("pos"), F.lit("]}").alias("line")),
        )
    )
    lines = data.unionByName(data.select("file_name").distinct().select("file_name", ends))
    return write_files(lines.unionByName(spark.createDataFrame([("none.json", 0, '{"sgs":null}')], lines.schema)), "documents")


JSON_CTE = """documents_used AS (
  SELECT CAST(event_id AS VARCHAR) AS source, CAST(user_id AS VARCHAR) AS subject_id,
         date_trunc('millisecond', ts) AS ts,
         CASE WHEN event_type = 'click' THEN ROUND(value - 100, 2) ELSE value END AS shown,
         event_type NOT IN ('error', 'signup') AS readable
  FROM events),
json_readings AS (
  SELECT source, subject_id, ts + k * INTERVAL 1 MINUTE AS ts, shown AS glucose_mg_dl
  FROM documents_used, (VALUES (0), (1)) copies(k)
  WHERE readable AND shown > 0)"""


# --- XML documents --------------------------------------------------------------------------


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event, named by subject and split.

    ``error`` events lack their value, ``view`` events are glucose, the rest as in ``streams``.
    Doses above 1 carry their time as ``ts_begin`` and the type ``square``.
    """
    at = F.date_format("ts", "dd-MM-yyyy HH:mm:ss")
    value = F.col("value").cast("string")
    bolus = F.when(
        F.col("value") > 50,
        F.format_string('<event ts_begin="%s" ts="" dose="%s" type="square"/>', at, value),
    ).otherwise(F.format_string('<event ts="%s" dose="%s"/>', at, value))
    element = (
        F.when(
            is_type("view"),
            F.format_string(
                '<glucose_level><event ts="%s" value="%s"/></glucose_level><meal/>', at, value
            ),
        )
        .when(
            is_type("error"),
            F.format_string('<glucose_level><event ts="%s" value=""/></glucose_level>', at),
        )
        .when(is_type("purchase"), F.concat(F.lit("<bolus>"), bolus, F.lit("</bolus>")))
        .when(
            is_type("click"),
            F.format_string(
                '<basal><event ts="%s" value="%s"/><event ts="soon" value="1"/></basal>',
                at,
                value,
            ),
        )
        .otherwise(F.format_string('<meal><event ts="%s" carbs="%s"/></meal>', at, value))
    )
    split = F.when(F.col("ts") < ntz(SPLIT_AT), "training").otherwise("testing")
    return events(spark, sf_dir).select(
        F.concat(F.col("user_id"), F.lit("-ws-"), split, F.lit(".xml")).alias("file_name"),
        F.format_string('<patient id="%d">%s</patient>', "user_id", element).alias("text"),
        F.col("event_id").alias("pos"),
        element.alias("element"),
    )


def xml_files(spark: SparkSession, sf_dir: str) -> str:
    """A table of pieces with one document per subject and split; its streams come in many
    elements."""
    docs = xml_documents(spark, sf_dir).select("file_name", "pos", F.col("element").alias("line"))
    ends = F.inline(
        F.array(
            F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit("<export>").alias("line")),
            F.struct(F.lit((1 << 63) - 1).alias("pos"), F.lit("</export>").alias("line")),
        )
    )
    return write_files(docs.unionByName(docs.select("file_name").distinct().select("file_name", ends)), "events")


XML_CTE = f"""xml_events AS (
  SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id AS pos,
         CASE WHEN event_type = 'view' THEN 'glucose' WHEN event_type = 'purchase' THEN 'bolus'
              WHEN event_type = 'click' THEN 'basal' ELSE 'meal' END AS stream,
         date_trunc('second', ts) AS ts, value,
         CASE WHEN event_type = 'purchase'
              THEN CASE WHEN value > 50 THEN 'square' ELSE 'normal' END END AS detail,
         CASE WHEN ts < TIMESTAMP '{SPLIT_AT}' THEN 'training' ELSE 'testing' END AS split
  FROM events WHERE event_type <> 'error')"""
