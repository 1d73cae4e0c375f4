"""Clinical statistics of readings, over everything or per group.

Each is one aggregate with map-side partial results, so a group of any size costs one buffer
per task and shuffles one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sugarline import constants as C
from sugarline.functions import clinical
from sugarline.functions.exact import exact_avg, exact_parts, from_parts
from sugarline.functions.rounding import half_even, half_up

GLUCOSE = "glucose_mg_dl"
#: Deviations of partial means are taken from here, near most means.
MIDDLE = 150.0


def _share(condition: Column) -> Column:
    """Fraction of the rows for which the condition holds; NULL without rows."""
    return F.try_divide(F.count_if(condition), F.count(F.lit(1)))


def _moments(readings: DataFrame, groups: tuple[str, ...], value: str) -> DataFrame:
    v = F.col(value)
    return (
        readings.where(v.isNotNull())
        .groupBy(*groups)
        .agg(
            F.count(v).alias("count"),
            F.min(v).alias("_min"),
            F.max(v).alias("_max"),
            exact_avg(value).alias("_avg"),
            F.var_pop(v).alias("_var"),
            _share(clinical.in_range(v)).alias("_in_range"),
        )
    )


def time_in_range(readings: DataFrame, *groups: str, value: str = GLUCOSE) -> DataFrame:
    """Percentage of readings inside the target range, 0.0 when there are none."""
    v = F.col(value)
    share = _share(clinical.in_range(v)) * 100
    return (
        readings.where(v.isNotNull())
        .groupBy(*groups)
        .agg(F.coalesce(half_even(share, 2), F.lit(0.0)).alias("time_in_range_percent"))
    )


def glycemic_statistics(readings: DataFrame, *groups: str, value: str = GLUCOSE) -> DataFrame:
    """Count, extremes, mean, population deviation, time in range, GMI and CV.

    The figures are chained through their rounded values: the deviation is taken around the
    rounded mean (mean((v - a)^2) = variance + (mean - a)^2), GMI uses the rounded mean, CV
    both rounded figures and the stability flag the rounded CV.
    """
    m = _moments(readings, groups, value)
    m = m.withColumn("avg_glucose", half_even(F.col("_avg"), 2))
    spread = F.col("_var") + F.pow(F.col("_avg") - F.col("avg_glucose"), F.lit(2.0))
    m = m.withColumn("std_dev", half_even(F.sqrt(spread), 2))
    m = m.withColumn("cv_percent", clinical.cv_percent(F.col("std_dev"), F.col("avg_glucose")))
    return m.select(
        *groups,
        "count",
        half_even(F.col("_min"), 2).alias("min_glucose"),
        half_even(F.col("_max"), 2).alias("max_glucose"),
        "avg_glucose",
        "std_dev",
        F.coalesce(half_even(F.col("_in_range") * 100, 2), F.lit(0.0)).alias(
            "time_in_range_percent"
        ),
        clinical.gmi(F.col("avg_glucose")).alias("gmi"),
        "cv_percent",
        (F.col("cv_percent") < C.CV_STABLE_BELOW).alias("cv_is_stable"),
    )


def client_statistics(readings: DataFrame, *groups: str, value: str = GLUCOSE) -> DataFrame:
    """The same figures from unrounded intermediates, rounded half-up for display.

    No readings give no row. A mean of zero gives a NULL CV, which is not stable.
    """
    return _displayed(_moments(readings, groups, value).where(F.col("count") > 0), groups)


def mergeable_moments(readings: DataFrame, *groups: str, value: str = GLUCOSE) -> DataFrame:
    """Count, extremes, readings in range, exact sum and squared deviations per group, for
    :func:`merged_client_statistics`."""
    v = F.col(value)
    whole, rest = exact_parts(value)
    return (
        readings.where(v.isNotNull())
        .groupBy(*groups)
        .agg(
            F.count(v).alias("n"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.count_if(clinical.in_range(v)).alias("in_range"),
            whole.alias("whole"),
            rest.alias("rest"),
            (F.var_pop(v) * F.count(v)).alias("squares"),
        )
    )


def merged_client_statistics(moments: DataFrame, *groups: str) -> DataFrame:
    """:func:`client_statistics` of the union of the readings behind several moments.

    Squared deviations add up, plus the spread of the means around a fixed middle less that of the
    whole around it.
    """
    mean = from_parts(F.col("whole"), F.col("rest")) / F.col("n") - MIDDLE
    merged = moments.groupBy(*groups).agg(
        F.sum("n").alias("count"),
        F.min("low").alias("_min"),
        F.max("high").alias("_max"),
        (F.sum("in_range") / F.sum("n")).alias("_in_range"),
        (from_parts(F.sum("whole"), F.sum("rest")) / F.sum("n")).alias("_avg"),
        F.sum(F.col("squares") + F.col("n") * mean * mean).alias("_squares"),
    )
    middle = F.col("_avg") - MIDDLE
    variance = F.greatest(F.col("_squares") / F.col("count") - middle * middle, F.lit(0.0))
    return _displayed(merged.withColumn("_var", variance), groups)


def _displayed(m: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    std = F.sqrt(F.col("_var"))
    cv = F.try_divide(std, F.col("_avg")) * 100
    return m.select(
        *groups,
        "count",
        half_up(F.col("_min")).alias("min_glucose"),
        half_up(F.col("_max")).alias("max_glucose"),
        half_up(F.col("_avg")).alias("avg_glucose"),
        half_up(std, 1).alias("std_dev"),
        half_up(F.col("_in_range") * 100, 1).alias("time_in_range_percent"),
        half_up(C.GMI_INTERCEPT + C.GMI_SLOPE * F.col("_avg"), 2).alias("gmi"),
        half_up(cv, 1).alias("cv_percent"),
        F.coalesce(cv < C.CV_STABLE_BELOW, F.lit(False)).alias("cv_is_stable"),
    )


def classify_readings(readings: DataFrame, value: str = GLUCOSE) -> tuple[DataFrame, DataFrame]:
    """Valid readings with zone, critical flag and message; and the rejected ones."""
    v = F.col(value)
    valid = clinical.is_valid(v)
    accepted = (
        readings.where(valid)
        .withColumn("zone", clinical.zone(v))
        .withColumn("is_critical", clinical.zone_is_critical(F.col("zone")))
        .withColumn("message", clinical.zone_message(F.col("zone")))
    )
    return accepted, readings.where(~valid)
