"""Report tables and the stored feature table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sugarline import constants as C
from sugarline.operators import report
from sugarline.plans.features import build_feature_frame
from sugarline.plans.report import eda_report as full_report
from sugarline.registry import fixtures as fx
from sugarline.registry.base import registry
from sugarline.registry.clinical_queries import mean
from sugarline.registry.feature_queries import TIMELINE, rounded, rounded_sql
from sugarline.session import scratch_dir
from sugarline.sources import features_table

QUERIES, ORACLE, query = registry()


def one_decimal(x: str) -> str:
    return f"round_even({x} * 10, 0) / 10"


def percent(condition: str) -> str:
    return one_decimal(f"AVG(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END) * 100")


SPLIT = f"CASE WHEN ts < TIMESTAMP '{fx.SPLIT_AT}' THEN 'training' ELSE 'testing' END AS split"
SPLIT_FEATURES = f"{TIMELINE}, parts AS (SELECT *, {SPLIT} FROM exact_features)"


def _features(spark, sf_dir):
    return fx.by_split(build_feature_frame(fx.streams(spark, sf_dir), fx.CADENCE))


def _stored(spark, sf_dir):
    """The feature table written split by split to the shared scratch folder and read back."""
    path = scratch_dir(spark, "features")
    features = _features(spark, sf_dir)
    for split in C.SPLITS:
        part = features.where(F.col("split") == split).drop("split")
        features_table.write_features(part, path, split)
    return features_table.read_features(spark, path)


# --- on readings ----------------------------------------------------------------------------


def zones_sql(source: str) -> str:
    v = "glucose_mg_dl"
    return f"""SELECT subject_id, {percent(f"{v} < 54")} AS severe_hypo_percent,
  {percent(f"{v} >= 54 AND {v} < 70")} AS hypo_percent,
  {percent(f"{v} BETWEEN 70 AND 180")} AS in_range_percent,
  {percent(f"{v} > 180 AND {v} <= 250")} AS hyper_percent,
  {percent(f"{v} > 250")} AS severe_hyper_percent
FROM {source} GROUP BY subject_id"""


def hypo_sql(source: str) -> str:
    return f"""SELECT subject_id, {percent("glucose_mg_dl < 70")} AS hypo_percent,
  {percent("glucose_mg_dl < 54")} AS severe_percent, COUNT(*) AS n
FROM {source} GROUP BY subject_id"""


def summary_sql(source: str, where: str = "") -> str:
    v = "glucose_mg_dl"
    return f"""SELECT subject_id, COUNT({v}) AS n, {one_decimal(f"FAVG({v})")} AS mean,
  {one_decimal(f"STDDEV_SAMP({v})")} AS std, {one_decimal(f"MIN({v})")} AS min,
  {one_decimal(f"MAX({v})")} AS max
FROM {source} {where} GROUP BY subject_id"""


@query(f"WITH {fx.READINGS_CTE} {zones_sql('readings')}")
def zone_breakdown(spark, sf_dir):
    return report.zone_breakdown(fx.readings(spark, sf_dir))


@query(f"WITH {fx.READINGS_CTE} {hypo_sql('readings')}")
def hypo_prevalence(spark, sf_dir):
    return report.hypo_prevalence(fx.readings(spark, sf_dir))


@query(f"WITH {fx.READINGS_CTE} {summary_sql('readings')}")
def summary_by_subject(spark, sf_dir):
    return report.summary_by_subject(fx.readings(spark, sf_dir))


def histogram_sql(source: str) -> str:
    return f"""WITH values_of AS (SELECT * FROM {source} WHERE glucose_mg_dl IS NOT NULL),
ranges AS (
  SELECT subject_id, MIN(glucose_mg_dl) AS mn, MAX(glucose_mg_dl) AS mx,
         {mean("glucose_mg_dl")} AS mean_glucose FROM values_of GROUP BY subject_id),
widened AS (
  SELECT subject_id, mean_glucose, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS low,
         CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS high FROM ranges),
counts AS (
  SELECT subject_id,
         CAST(LEAST(FLOOR((glucose_mg_dl - low) / (high - low) * 60), 59) AS INTEGER) AS bin,
         COUNT(*) AS n
  FROM values_of JOIN widened USING (subject_id) GROUP BY ALL)
SELECT subject_id, bin, ROUND(low + bin * ((high - low) / 60), 9) AS bin_start,
       COALESCE(n, 0) AS n, ROUND(mean_glucose, 9) AS mean_glucose
FROM widened CROSS JOIN (SELECT UNNEST(RANGE(60))::INTEGER AS bin) slots
LEFT JOIN counts USING (subject_id, bin)"""


@query(f"WITH {fx.READINGS_CTE}, bars AS ({histogram_sql('readings')}) SELECT * FROM bars")
def glucose_histogram(spark, sf_dir):
    return rounded(report.glucose_histogram(fx.readings(spark, sf_dir)), 9)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id FROM events ORDER BY subject_id")
def distinct_subjects(spark, sf_dir):
    return features_table.distinct_subjects(fx.readings(spark, sf_dir))


# --- on features ----------------------------------------------------------------------------


def _correlation_cell(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    first = f"CASE WHEN {both} THEN {x} END"
    second = f"CASE WHEN {both} THEN {y} END"
    return (
        f"COVAR_POP({first}, {second})"
        f" / NULLIF(STDDEV_POP({first}) * STDDEV_POP({second}), 0)"
    )


def correlation_sql(source: str, where: str) -> str:
    pairs = list(combinations(C.FEATURES, 2)) + [(c, c) for c in C.FEATURES]
    wide = ", ".join(f"{_correlation_cell(x, y)} AS c{i}" for i, (x, y) in enumerate(pairs))
    cells = []
    for i, (x, y) in enumerate(pairs):
        for a, b in {(x, y), (y, x)}:
            cells.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, c{i} AS r FROM wide")
    return f"""wide AS (SELECT {wide} FROM {source} {where}),
matrix AS (SELECT feature_x, feature_y, ROUND(r, 6) AS correlation
           FROM ({' UNION ALL '.join(cells)}))"""


def missing_sql(source: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature,"
        f" ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_percent"
        f" FROM {source} {where}"
        for c in C.FEATURES
    )


TRAINING = "WHERE split = 'training'"


def _training(spark, sf_dir):
    return _features(spark, sf_dir).where(F.col("split") == "training")


@query(f"{SPLIT_FEATURES}, {correlation_sql('parts', TRAINING)} SELECT * FROM matrix")
def correlation_matrix(spark, sf_dir):
    return rounded(report.correlation_matrix(_training(spark, sf_dir)), 6)


@query(f"{SPLIT_FEATURES} {missing_sql('parts', TRAINING)}")
def missing_percent(spark, sf_dir):
    return rounded(report.missing_percent(_training(spark, sf_dir)), 6)


PROFILE_SQL = """SELECT {label} AS part, COUNT(*) AS rows, 14 AS columns,
  COUNT(DISTINCT subject_id) AS subjects, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM parts"""


@query(
    f"""{SPLIT_FEATURES} {PROFILE_SQL.format(label='split')} GROUP BY split
UNION ALL {PROFILE_SQL.format(label="'total'")}"""
)
def dataset_profile(spark, sf_dir):
    return report.dataset_profile(_features(spark, sf_dir))


@query(f"{SPLIT_FEATURES} SELECT {rounded_sql()}, split FROM parts")
def write_features(spark, sf_dir):
    return rounded(_stored(spark, sf_dir))


@query(f"{SPLIT_FEATURES} SELECT {rounded_sql()}, split FROM parts")
def read_features(spark, sf_dir):
    """Both splits, each read by its name."""
    stored = _stored(spark, sf_dir)
    parts = [stored.where(F.col("split") == split) for split in C.SPLITS]
    return rounded(features_table.union_splits(*parts))


def _long(source: str, section: str, item: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric,"
        f" CAST({m} AS DOUBLE) AS value FROM {source}"
        for m in metrics
    )


ZONE_COLUMNS = [
    "severe_hypo_percent",
    "hypo_percent",
    "in_range_percent",
    "hyper_percent",
    "severe_hyper_percent",
]


@query(
    f"""{SPLIT_FEATURES}, {correlation_sql('parts', TRAINING)},
spans AS ({PROFILE_SQL.format(label='split')} GROUP BY split
            UNION ALL {PROFILE_SQL.format(label="'total'")}),
profile AS (SELECT part, rows, columns, subjects, epoch_us(first_ts) / 1000000.0 AS first_ts,
                   epoch_us(last_ts) / 1000000.0 AS last_ts FROM spans),
listed AS (SELECT DISTINCT subject_id, 1 AS present FROM parts),
bars AS ({histogram_sql('parts')}),
zones AS ({zones_sql('parts')}), hypo AS ({hypo_sql('parts')}),
summary AS ({summary_sql('parts', TRAINING)}), missing AS ({missing_sql('parts', TRAINING)})
SELECT section, item, metric, ROUND(value, 6) AS value FROM (
{_long('profile', 'profile', 'part', ['rows', 'columns', 'subjects', 'first_ts', 'last_ts'])} UNION ALL
{_long('listed', 'subjects', 'subject_id', ['present'])} UNION ALL
{_long('bars', 'histogram', "subject_id || ' ' || bin", ['bin_start', 'n', 'mean_glucose'])} UNION ALL
{_long('zones', 'zones', 'subject_id', ZONE_COLUMNS)} UNION ALL
{_long('matrix', 'correlation', "feature_x || ' ~ ' || feature_y", ['correlation'])} UNION ALL
{_long('missing', 'missing', 'feature', ['missing_percent'])} UNION ALL
{_long('hypo', 'hypo', 'subject_id', ['hypo_percent', 'severe_percent', 'n'])} UNION ALL
{_long('summary', 'summary', 'subject_id', ['n', 'mean', 'std', 'min', 'max'])})"""
)
def eda_report(spark, sf_dir):
    return rounded(full_report(_stored(spark, sf_dir)), 6)
