"""Clinical column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from sugarline import constants as C
from sugarline.functions.rounding import half_even, half_up


def zone(glucose: Column) -> Column:
    severe_hypo, hypo, normal, hyper, severe_hyper = C.ZONES
    return (
        F.when(glucose < C.SEVERE_HYPO_BELOW, severe_hypo)
        .when(glucose < C.HYPO_BELOW, hypo)
        .when(glucose <= C.HYPER_ABOVE, normal)
        .when(glucose <= C.SEVERE_HYPER_ABOVE, hyper)
        .when(glucose.isNotNull(), severe_hyper)
    )


def _zone_attribute(zone_name: Column, index: int) -> Column:
    result = None
    for name, attributes in C.ZONES.items():
        value = F.lit(attributes[index])
        result = (
            F.when(zone_name == name, value)
            if result is None
            else result.when(zone_name == name, value)
        )
    return result


def zone_is_critical(zone_name: Column) -> Column:
    return _zone_attribute(zone_name, 0)


def zone_message(zone_name: Column) -> Column:
    return _zone_attribute(zone_name, 1)


def in_range(glucose: Column) -> Column:
    """Target range, both ends included."""
    return glucose.between(C.HYPO_BELOW, C.HYPER_ABOVE)


def is_valid(glucose: Column) -> Column:
    return F.coalesce(glucose.between(C.VALID_MIN, C.VALID_MAX), F.lit(False))


def is_hypo(glucose: Column) -> Column:
    return (glucose < C.HYPO_BELOW).cast("int")


def is_hyper(glucose: Column) -> Column:
    return (glucose > C.HYPER_ABOVE).cast("int")


def gmi(avg_glucose: Column) -> Column:
    return half_even(C.GMI_INTERCEPT + C.GMI_SLOPE * avg_glucose, 2)


def cv_percent(std_dev: Column, avg_glucose: Column) -> Column:
    return F.when(avg_glucose == 0, F.lit(0.0)).otherwise(
        half_even(F.try_divide(std_dev, avg_glucose) * 100, 2)
    )


def tir_band(tir_percent: Column) -> Column:
    return (
        F.when(tir_percent >= C.TIR_GOOD_FROM, "good")
        .when(tir_percent >= C.TIR_FAIR_FROM, "fair")
        .otherwise("poor")
    )


def stability_label(stable: Column) -> Column:
    return F.when(stable, "Stable").when(~stable, "Unstable").otherwise("")


def cyclical_time(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week (Monday = 0) on the unit circle."""
    hour = F.hour(ts) * (2 * math.pi) / 24
    day = F.weekday(ts) * (2 * math.pi) / 7
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "dow_sin": F.sin(day),
        "dow_cos": F.cos(day),
    }


def chart_trace(ts: Column, glucose: Column, tz: str = "UTC") -> dict[str, Column]:
    """Wall-clock label in ``tz``, rounded value, and the band of the rounded value."""
    shown = half_up(glucose)
    return {
        "time_label": F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), tz), "HH:mm"),
        "glucose": shown.cast("bigint"),
        "band": F.when(shown < C.HYPO_BELOW, "low")
        .when(shown > C.HYPER_ABOVE, "high")
        .when(shown.isNotNull(), "in_range"),
    }
