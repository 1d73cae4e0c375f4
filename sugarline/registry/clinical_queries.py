"""Parsing, classification and statistics of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarline.functions import clinical, parsing
from sugarline.operators import statistics as st
from sugarline.plans import ingest
from sugarline.registry import fixtures as fx
from sugarline.registry.base import registry
from sugarline.sources import csv_export, xml_events

QUERIES, ORACLE, query = registry()


def r2(x: str) -> str:
    """Half-even on the binary value, two decimals."""
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


def mean(x: str) -> str:
    """Mean from an error-free sum of the binary values, as Python's compensated ``sum`` has it;
    neither a plain, a Kahan nor a decimal sum gives the same last bit at rounding ties."""
    whole = f"round_even({x} * 1024, 0)"
    total = f"CAST(SUM(CAST({whole} AS BIGINT)) AS DOUBLE) / 1024 + SUM({x} - {whole} / 1024)"
    return f"({total}) / COUNT({x})"


def statistics_sql(source: str, group: str, value: str = "glucose_mg_dl") -> str:
    """CTEs ending in ``stats``: the chained statistics of ``source`` per ``group``."""
    return f"""means AS (
  SELECT {group}, COUNT({value}) AS n, MIN({value}) AS lo, MAX({value}) AS hi,
         {r2(mean(value))} AS a,
         {r2(f"AVG(CASE WHEN {value} BETWEEN 70 AND 180 THEN 1.0 ELSE 0.0 END) * 100")} AS tir
  FROM {source} GROUP BY {group}),
spreads AS (
  SELECT {group}, {r2(f"SQRT(AVG(({value} - a) * ({value} - a)))")} AS sd
  FROM {source} JOIN means USING ({group}) GROUP BY {group}),
coefficients AS (
  SELECT *, CASE WHEN a = 0 THEN 0.0 ELSE {r2("sd / a * 100")} END AS cv
  FROM means JOIN spreads USING ({group})),
stats AS (
  SELECT {group}, n AS count, {r2("lo")} AS min_glucose, {r2("hi")} AS max_glucose,
         a AS avg_glucose, sd AS std_dev, tir AS time_in_range_percent,
         {r2("3.31 + 0.02392 * a")} AS gmi, cv AS cv_percent, cv < 36.0 AS cv_is_stable
  FROM coefficients)"""


def client_statistics_sql(source: str, groups: str, value: str = "glucose_mg_dl") -> str:
    return f"""SELECT {groups}, COUNT(*) AS count, FLOOR(MIN({value}) + 0.5) AS min_glucose,
  FLOOR(MAX({value}) + 0.5) AS max_glucose, FLOOR({mean(value)} + 0.5) AS avg_glucose,
  FLOOR(STDDEV_POP({value}) * 10 + 0.5) / 10 AS std_dev,
  FLOOR(AVG(CASE WHEN {value} BETWEEN 70 AND 180 THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 10
    AS time_in_range_percent,
  FLOOR((3.31 + 0.02392 * {mean(value)}) * 100 + 0.5) / 100 AS gmi,
  FLOOR(STDDEV_POP({value}) / ({mean(value)}) * 1000 + 0.5) / 10 AS cv_percent,
  STDDEV_POP({value}) / ({mean(value)}) * 100 < 36 AS cv_is_stable
FROM {source} GROUP BY {groups}"""


# --- parsers --------------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN value < 5 THEN 39.0 WHEN value > 300 THEN 401.0
         WHEN event_type = 'error' THEN NULL ELSE value END AS glucose_mg_dl FROM events"""
)
def decode_sentinel(spark, sf_dir):
    text = F.col("value").cast("string")
    cell = (
        F.when(F.col("value") < 5, " Low")
        .when(F.col("value") > 300, "High")
        .when(fx.is_type("error"), F.concat(text, F.lit("d")))
        .when(fx.is_type("view"), F.concat(F.lit("\t"), text, F.lit("  ")))
        .when(fx.is_type("click"), F.concat(F.lit("+"), text, F.lit("e0")))
        .otherwise(text)
    )
    return fx.events(spark, sf_dir).select(
        "event_id", parsing.decode_sentinel(cell).alias("glucose_mg_dl")
    )


@query(
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts
       FROM events"""
)
def parse_csv_ts(spark, sf_dir):
    def text(padded: str, short: str, wrong: str):
        return (
            F.when(fx.is_type("click"), F.date_format("ts", short))
            .when(fx.is_type("error"), F.date_format("ts", wrong))
            .otherwise(F.concat(F.lit(" "), F.date_format("ts", padded)))
        )

    date = text("yyyy/MM/dd", "yyyy/M/d", "yy/MM/dd")
    time = text("HH:mm:ss", "H:m:s", "HH:mm:ss")
    return fx.events(spark, sf_dir).select(
        "event_id", parsing.parse_csv_ts(date, time).alias("ts")
    )


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def epoch_ms_to_ts(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    return fx.events(spark, sf_dir).select("event_id", parsing.epoch_ms_to_ts(ms).alias("ts"))


@query(
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts
       FROM events"""
)
def parse_xml_ts(spark, sf_dir):
    text = (
        F.when(fx.is_type("click"), F.date_format("ts", "d-M-yyyy H:m:s"))
        .when(fx.is_type("error"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
    )
    return fx.events(spark, sf_dir).select("event_id", parsing.parse_xml_ts(text).alias("ts"))


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'from ts' ELSE 'begin' END
         AS chosen FROM events"""
)
def coalesce_bolus_ts(spark, sf_dir):
    begin = F.when(fx.is_type("click"), "").when(~fx.is_type("view"), "begin")
    chosen = parsing.coalesce_bolus_ts(begin, F.lit("from ts"))
    return fx.events(spark, sf_dir).select("event_id", chosen.alias("chosen"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'normal'
         ELSE 'square' END AS bolus_type FROM events"""
)
def default_bolus_type(spark, sf_dir):
    given = F.when(fx.is_type("click"), "").when(~fx.is_type("view"), "square")
    return fx.events(spark, sf_dir).select(
        "event_id", parsing.default_bolus_type(given).alias("bolus_type")
    )


# --- classification -------------------------------------------------------------------------

ZONE_SQL = """CASE WHEN v < 54 THEN 'severe_hypoglycemia' WHEN v < 70 THEN 'hypoglycemia'
  WHEN v <= 180 THEN 'normal' WHEN v <= 250 THEN 'hyperglycemia'
  ELSE 'severe_hyperglycemia' END"""
MESSAGE_SQL = """CASE
  WHEN v < 54 THEN 'CRITICAL: Severe hypoglycemia. Immediate action required.'
  WHEN v < 70 THEN 'WARNING: Hypoglycemia detected. Carbohydrate intake recommended.'
  WHEN v <= 180 THEN 'OK: Glucose within target range.'
  WHEN v <= 250 THEN 'WARNING: Hyperglycemia detected. Monitor closely.'
  ELSE 'CRITICAL: Severe hyperglycemia. Medical attention may be required.' END"""
CRITICAL_SQL = "(v < 70 OR v > 250)"


def _wide(spark, sf_dir):
    """Readings stretched beyond the valid range at both ends."""
    value = F.round(F.col("glucose_mg_dl") * 2 - 20, 2)
    return fx.readings(spark, sf_dir).select("pos", value.alias("glucose_mg_dl"))


WIDE_CTE = "wide AS (SELECT event_id AS pos, ROUND(value * 2 - 20, 2) AS v FROM events)"


@query(f"""SELECT pos, {ZONE_SQL} AS zone FROM (SELECT event_id AS pos, value AS v FROM events)""")
def classify_zone(spark, sf_dir):
    return fx.readings(spark, sf_dir).select(
        "pos", clinical.zone(F.col("glucose_mg_dl")).alias("zone")
    )


@query(
    f"""WITH {WIDE_CTE}
SELECT pos, v AS glucose_mg_dl, {ZONE_SQL} AS zone, {CRITICAL_SQL} AS is_critical,
       {MESSAGE_SQL} AS message
FROM wide WHERE v BETWEEN 0 AND 600"""
)
def classify_readings(spark, sf_dir):
    return st.classify_readings(_wide(spark, sf_dir))[0]


@query(f"WITH {WIDE_CTE} SELECT pos, v AS glucose_mg_dl FROM wide WHERE v < 0 OR v > 600")
def validate_range(spark, sf_dir):
    """The rejected side."""
    return st.classify_readings(_wide(spark, sf_dir))[1]


@query(
    """SELECT event_id AS pos, CAST(value < 70 AS INTEGER) AS is_hypo,
         CAST(value > 180 AS INTEGER) AS is_hyper FROM events"""
)
def clinical_flags(spark, sf_dir):
    v = F.col("glucose_mg_dl")
    return fx.readings(spark, sf_dir).select(
        "pos", clinical.is_hypo(v).alias("is_hypo"), clinical.is_hyper(v).alias("is_hyper")
    )


@query(
    """SELECT event_id AS pos,
         ROUND(SIN(2 * PI() * EXTRACT(hour FROM ts) / 24), 9) AS hour_sin,
         ROUND(COS(2 * PI() * EXTRACT(hour FROM ts) / 24), 9) AS hour_cos,
         ROUND(SIN(2 * PI() * (EXTRACT(isodow FROM ts) - 1) / 7), 9) AS dow_sin,
         ROUND(COS(2 * PI() * (EXTRACT(isodow FROM ts) - 1) / 7), 9) AS dow_cos
       FROM events"""
)
def cyclical_time(spark, sf_dir):
    columns = clinical.cyclical_time(F.col("ts"))
    return fx.readings(spark, sf_dir).select(
        "pos", *[F.round(c, 9).alias(name) for name, c in columns.items()]
    )


@query(
    """WITH shown AS (SELECT event_id AS pos, ts, CAST(FLOOR(value + 0.5) AS BIGINT) AS glucose
                      FROM events)
SELECT pos, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS time_label, glucose,
       CASE WHEN glucose < 70 THEN 'low' WHEN glucose > 180 THEN 'high' ELSE 'in_range' END AS band
FROM shown"""
)
def chart_trace(spark, sf_dir):
    """In a zone one hour ahead of UTC throughout the data's month."""
    columns = clinical.chart_trace(F.col("ts"), F.col("glucose_mg_dl"), "Europe/Warsaw")
    return fx.readings(spark, sf_dir).select(
        "pos", *[c.alias(name) for name, c in columns.items()]
    )


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id FROM events")
def subject_tag(spark, sf_dir):
    docs = fx.xml_documents(spark, sf_dir)
    return docs.select(xml_events.subject_of(F.col("file_name")).alias("subject_id")).distinct()


# --- statistics -----------------------------------------------------------------------------


@query(f"WITH {fx.READINGS_CTE}, {statistics_sql('readings', 'subject_id')} SELECT * FROM stats")
def glycemic_statistics(spark, sf_dir):
    return st.glycemic_statistics(fx.readings(spark, sf_dir), "subject_id")


@query(
    f"""WITH everything AS (SELECT 1 AS g, value AS glucose_mg_dl FROM events),
{statistics_sql('everything', 'g')} SELECT * EXCLUDE (g) FROM stats"""
)
def glycemic_statistics_overall(spark, sf_dir):
    return st.glycemic_statistics(fx.readings(spark, sf_dir))


@query(f"WITH {statistics_sql('lineitem', 'l_suppkey', 'l_quantity')} SELECT * FROM stats")
def glycemic_statistics_lineitem(spark, sf_dir):
    """The same aggregate on the largest table, for timing."""
    lines = fx.table(spark, sf_dir, "lineitem")
    return st.glycemic_statistics(lines, "l_suppkey", value="l_quantity")


@query(f"WITH {fx.READINGS_CTE} {client_statistics_sql('readings', 'subject_id')}")
def client_statistics(spark, sf_dir):
    return st.client_statistics(fx.readings(spark, sf_dir), "subject_id")


@query(
    f"""WITH {fx.READINGS_CTE}, {statistics_sql('readings', 'subject_id')}
SELECT subject_id, time_in_range_percent FROM stats"""
)
def time_in_range(spark, sf_dir):
    return st.time_in_range(fx.readings(spark, sf_dir), "subject_id")


def _stats(spark, sf_dir):
    return st.glycemic_statistics(fx.readings(spark, sf_dir), "subject_id")


@query(
    f"""SELECT CAST(user_id AS VARCHAR) AS subject_id, {r2(f"3.31 + 0.02392 * {r2(mean('value'))}")}
          AS gmi FROM events GROUP BY user_id"""
)
def gmi(spark, sf_dir):
    return _stats(spark, sf_dir).select("subject_id", "gmi")


@query(
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS subject_id,
          CASE WHEN AVG(l_discount) = 0 THEN 0.0
               ELSE {r2("STDDEV_POP(l_discount) / AVG(l_discount) * 100")} END AS cv_percent
        FROM lineitem GROUP BY l_suppkey"""
)
def cv_percent(spark, sf_dir):
    spread = clinical.cv_percent(F.stddev_pop("l_discount"), F.avg("l_discount"))
    return (
        fx.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("subject_id"))
        .agg(spread.alias("cv_percent"))
    )


@query(
    f"""WITH {fx.READINGS_CTE}, {statistics_sql('readings', 'subject_id')}
SELECT subject_id, CASE WHEN time_in_range_percent >= 70 THEN 'good'
         WHEN time_in_range_percent >= 50 THEN 'fair' ELSE 'poor' END AS tir_band
FROM stats"""
)
def tir_band(spark, sf_dir):
    band = clinical.tir_band(F.col("time_in_range_percent")).alias("tir_band")
    return _stats(spark, sf_dir).select("subject_id", band)


@query(
    f"""WITH {fx.READINGS_CTE}, {statistics_sql('readings', 'subject_id')}
SELECT subject_id, CASE WHEN cv_is_stable THEN 'Stable' ELSE 'Unstable' END AS stability
FROM stats"""
)
def stability_label(spark, sf_dir):
    label = clinical.stability_label(F.col("cv_is_stable")).alias("stability")
    return _stats(spark, sf_dir).select("subject_id", label)


@query(
    """SELECT '/exports/' || user_id || '.csv' AS source, COUNT(*) AS readings_saved
       FROM events GROUP BY user_id"""
)
def ingest_counts(spark, sf_dir):
    source = F.concat(F.lit("/exports/"), F.col("subject_id"), F.lit(".csv")).alias("source")
    return ingest.ingest_counts(fx.readings(spark, sf_dir).select(source))


@query("SELECT DISTINCT user_id || '.csv' AS source FROM events WHERE event_type = 'view'")
def accept_csv_only(spark, sf_dir):
    ending = F.when(fx.is_type("view"), ".csv").when(fx.is_type("click"), ".CSV").otherwise(".txt")
    names = fx.events(spark, sf_dir).select(F.concat("user_id", ending).alias("source"))
    return csv_export.csv_only(names).distinct()
