import datetime as dt
import random

import pytest

from sugarline.operators import timeline
from sugarline.plans.features import COLUMNS, build_feature_frame
from tests import brute

SCHEMA = "subject_id string, stream string, ts timestamp_ntz, value double, pos bigint"
T0 = dt.datetime(2024, 1, 1)


def at(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def run(spark, events, cadence=300, chunk_bins=timeline.CHUNK_BINS):
    df = build_feature_frame(spark.createDataFrame(events, SCHEMA), cadence, chunk_bins)
    assert df.columns == list(COLUMNS)
    return {(r.subject_id, r.ts): r.asDict() for r in df.collect()}


def compare(spark, events, **kwargs):
    got = run(spark, events, **kwargs)
    want = brute.features(events, kwargs.get("cadence", 300))
    assert set(got) == set(want)
    for key, row in want.items():
        for name, value in row.items():
            if value is None:
                assert got[key][name] is None, (key, name)
            else:
                assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)
    return got


@pytest.mark.parametrize("gap,filled", [(1, 1), (3, 3), (4, 3), (7, 3)])
def test_gap_fills_first_three_bins_on_the_slope_of_the_whole_gap(spark, gap, filled):
    events = [("a", "glucose", at(0), 100.0, 0), ("a", "glucose", at(5 * (gap + 1)), 180.0, 1)]
    got = compare(spark, events)
    assert len(got) == 2 + filled
    assert got["a", at(5)]["glucose_mg_dl"] == pytest.approx(100 + 80 / (gap + 1))


def test_bolus_in_bin_without_glucose(spark):
    events = [
        ("a", "glucose", at(0), 100.0, 0),
        ("a", "glucose", at(30), 130.0, 1),
        ("a", "bolus", at(10), 2.0, 0),  # third bin, interpolated: counted
        ("a", "bolus", at(20), 5.0, 1),  # fifth bin, dropped: lost
    ]
    got = compare(spark, events)
    assert got["a", at(30)]["bolus_last_1h"] == 2.0


def test_basal_is_not_an_as_of_join(spark):
    events = [
        ("a", "basal", at(-60), 9.0, 0),  # before the first glucose row: lost
        ("a", "glucose", at(0), 100.0, 0),
        ("a", "basal", at(5), 1.0, 1),  # two rates in one bin: last one holds
        ("a", "basal", at(7), 1.5, 2),
        ("a", "glucose", at(5), 100.0, 1),
        ("a", "basal", at(40), 7.0, 3),  # in a dropped bin: lost
        ("a", "glucose", at(60), 100.0, 2),
    ]
    got = compare(spark, events)
    assert got["a", at(0)]["basal_rate"] == 0.0
    assert got["a", at(5)]["basal_rate"] == 1.5
    assert got["a", at(60)]["basal_rate"] == 1.5


def test_same_timestamp_basal_takes_last_in_source_and_glucose_first(spark):
    events = [
        ("a", "glucose", at(1), 100.0, 0),
        ("a", "glucose", at(1), 300.0, 1),
        ("a", "glucose", at(2), 110.0, 2),
        ("a", "basal", at(1), 1.0, 0),
        ("a", "basal", at(1), 2.0, 1),
    ]
    got = compare(spark, events)
    assert got["a", at(0)]["glucose_mg_dl"] == 105.0
    assert got["a", at(0)]["basal_rate"] == 2.0


def test_absent_streams_and_subject_without_glucose(spark):
    events = [
        ("a", "glucose", at(0), 60.0, 0),
        ("b", "bolus", at(0), 1.0, 0),
        ("b", "basal", at(0), 1.0, 0),
    ]
    got = compare(spark, events)
    assert list(got) == [("a", at(0))]
    row = got["a", at(0)]
    assert (row["bolus_last_1h"], row["basal_rate"], row["carbs_last_1h"]) == (0.0, 0.0, 0.0)
    assert (row["is_hypo"], row["is_hyper"]) == (1, 0)


def test_empty_input(spark):
    assert run(spark, []) == {}


def test_rows_count_not_clock(spark):
    # 13 readings 30 minutes apart: with the filled bins the 12-row sum reaches 90 minutes back
    events = [("a", "glucose", at(30 * i), 100.0 + i, i) for i in range(13)]
    events += [("a", "bolus", at(30 * i), 1.0, i) for i in range(13)]
    got = compare(spark, events)
    assert got["a", at(360)]["bolus_last_1h"] == 3.0


def _random_events(seed, subjects=("a", "b", "c"), span=2000):
    rng = random.Random(seed)
    events = []
    for s in subjects:
        pos = 0
        minute = rng.randint(-500, 0)
        while minute < span:
            minute += rng.choice([1, 2, 5, 5, 5, 5, 10, 15, 20, 25, 40, 120, 400])
            for stream, scale in [("glucose", 300), ("bolus", 8), ("basal", 2), ("meal", 90)]:
                if rng.random() < (0.7 if stream == "glucose" else 0.3):
                    for _ in range(rng.choice([1, 1, 1, 2])):
                        value = round(rng.uniform(1, scale), 2)
                        events.append((s, stream, at(minute, rng.choice([0, 0, 30])), value, pos))
                        pos += 1
    rng.shuffle(events)
    return events


@pytest.mark.parametrize("chunk_bins", [1, 3, 12, 24, 2016])
def test_chunk_borders_do_not_show(spark, chunk_bins):
    """The result is that of whole-subject windows for any chunk length, even one bin."""
    compare(spark, _random_events(chunk_bins), chunk_bins=chunk_bins)


def test_hot_subject_and_other_cadence(spark):
    events = _random_events(5, subjects=("hot",), span=20000) + _random_events(6)
    compare(spark, events, cadence=3600, chunk_bins=4)


def test_copies_of_one_reading_collapse(spark):
    events = [("a", "glucose", at(0), 100.0, i) for i in range(500)]
    events += [("a", "glucose", at(5), 110.0, 500)]
    assert len(compare(spark, events)) == 2


def test_cadence_must_divide_a_day(spark):
    with pytest.raises(ValueError):
        timeline.check_cadence(7 * 60)
