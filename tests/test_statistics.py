import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sugarline.functions import clinical, parsing
from sugarline.functions.exact import exact_sum
from sugarline.functions.rounding import half_even, half_up
from sugarline.operators import report, statistics as st


def values(spark, *numbers, subject="a"):
    rows = [(subject, float(v) if v is not None else None) for v in numbers]
    return spark.createDataFrame(rows, "subject_id string, glucose_mg_dl double")


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "value,zone,critical",
    [
        (40.0, "severe_hypoglycemia", True),
        (53.9, "severe_hypoglycemia", True),
        (54.0, "hypoglycemia", True),
        (60.0, "hypoglycemia", True),
        (69.9, "hypoglycemia", True),
        (70.0, "normal", False),
        (120.0, "normal", False),
        (180.0, "normal", False),
        (180.1, "hyperglycemia", False),
        (200.0, "hyperglycemia", False),
        (250.0, "hyperglycemia", False),
        (300.0, "severe_hyperglycemia", True),
    ],
)
def test_zones(spark, value, zone, critical):
    row = st.classify_readings(values(spark, value))[0].first()
    assert (row.zone, row.is_critical) == (zone, critical)
    assert row.message


def test_out_of_range_is_rejected(spark):
    accepted, rejected = st.classify_readings(values(spark, 0, 600, 9999, -1, None))
    assert sorted(r.glucose_mg_dl for r in accepted.collect()) == [0.0, 600.0]
    assert rejected.count() == 3


@pytest.mark.parametrize(
    "numbers,tir",
    [([80, 100, 120, 150, 170], 100.0), ([50, 100, 120, 300], 50.0), ([], 0.0)],
)
def test_time_in_range(spark, numbers, tir):
    assert st.time_in_range(values(spark, *numbers)).first()[0] == tir


@pytest.mark.parametrize("std,avg,cv", [(30.0, 150.0, 20.0), (60.0, 120.0, 50.0), (10.0, 0.0, 0.0)])
def test_cv(spark, std, avg, cv):
    assert one(spark, clinical.cv_percent(F.lit(std), F.lit(avg))) == cv


@pytest.mark.parametrize("avg", [154.0, 70.0, 123.45])
def test_gmi(spark, avg):
    assert one(spark, clinical.gmi(F.lit(avg))) == round(3.31 + 0.02392 * avg, 2)


def test_statistics_of_nothing(spark):
    row = st.glycemic_statistics(values(spark)).first().asDict()
    assert row["count"] == 0 and row["time_in_range_percent"] == 0.0
    rest = {k: v for k, v in row.items() if k not in ("count", "time_in_range_percent")}
    assert set(rest.values()) == {None}
    assert st.client_statistics(values(spark)).count() == 0


def test_statistics_of_four(spark):
    row = st.glycemic_statistics(values(spark, 120, 80, 50, 200)).first()
    assert (row["count"], row.min_glucose, row.max_glucose) == (4, 50.0, 200.0)
    assert row.time_in_range_percent == 50.0
    assert st.glycemic_statistics(values(spark, 100, 105, 102, 98)).first().cv_is_stable is True


def chained(numbers):
    n = len(numbers)
    avg = round(math.fsum(numbers) / n, 2)
    std = round(math.sqrt(math.fsum((v - avg) ** 2 for v in numbers) / n), 2)
    cv = round(std / avg * 100, 2) if avg else 0.0
    tir = round(sum(70 <= v <= 180 for v in numbers) / n * 100, 2)
    return (n, min(numbers), max(numbers), avg, std, tir, round(3.31 + 0.02392 * avg, 2), cv, cv < 36)


def test_statistics_against_plain_python(spark):
    rng = random.Random(1)
    groups = {str(g): [round(rng.uniform(40, 400), 2) for _ in range(rng.choice([1, 2, 8, 64, 200]))] for g in range(60)}
    rows = [(g, v) for g, numbers in groups.items() for v in numbers]
    df = spark.createDataFrame(rows, "subject_id string, glucose_mg_dl double").repartition(7)
    got = {r.subject_id: tuple(r)[1:] for r in st.glycemic_statistics(df, "subject_id").collect()}
    assert got == {g: chained(numbers) for g, numbers in groups.items()}


def test_client_statistics(spark):
    row = st.client_statistics(values(spark, 100.5, 99.5, 60.0)).first()
    assert (row.min_glucose, row.max_glucose, row.avg_glucose) == (60.0, 101.0, 87.0)
    assert row.time_in_range_percent == 66.7
    zero = st.client_statistics(values(spark, 0.0, 0.0)).first()
    assert zero.cv_percent is None and zero.cv_is_stable is False


@pytest.mark.parametrize("x", [120.125, 2.675, 0.125, 1.005, -2.675, 1e-9, 123456.785, 99.995])
def test_half_even_is_exact(spark, x):
    assert one(spark, half_even(F.lit(x), 2)) == round(x, 2)


def test_half_up(spark):
    assert [one(spark, half_up(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [1.0, 2.0, 3.0, 0.0]


def test_exact_sum_does_not_depend_on_order_or_size(spark):
    rng = random.Random(2)
    numbers = [rng.uniform(0, 500) for _ in range(5000)] + [1e300, -1e300]
    df = values(spark, *numbers, None).repartition(5)
    small = [v for v in numbers if abs(v) < 1e6]
    total = df.where(F.abs("glucose_mg_dl") < 1e6).agg(exact_sum("glucose_mg_dl")).first()[0]
    assert total == math.fsum(small)
    large = [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 49) for _ in range(500)]
    totals = {
        values(spark, *sorted(large, key=key)).repartition(n).agg(exact_sum("glucose_mg_dl")).first()[0]
        for n, key in ((1, abs), (3, float), (7, str))
    }
    assert totals == {math.fsum(large)}
    assert df.agg(exact_sum("glucose_mg_dl")).first()[0] is not None
    assert df.limit(0).agg(exact_sum("glucose_mg_dl")).first()[0] is None


@pytest.mark.parametrize(
    "text,value",
    [
        ("120", 120.0), (" 1.5 ", 1.5), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("1e2", 100.0),
        ("1_000", 1000.0), ("12d", None), ("nan", None), ("inf", None), ("1e999", None),
        ("", None), ("1,5", None), ("0x10", None), ("Low", None), (None, None),
    ],
)
def test_numbers(spark, text, value):
    assert one(spark, parsing.parse_number(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(
    "text,value",
    [("Low", 39.0), ("High", 401.0), (" Low ", 39.0), ("low", None), ("110.5", 110.5), ("?", None)],
)
def test_sentinels(spark, text, value):
    assert one(spark, parsing.decode_sentinel(F.lit(text))) == value


def test_bands_and_labels(spark):
    bands = [one(spark, clinical.tir_band(F.lit(x))) for x in (70.0, 69.9, 50.0, 49.9)]
    assert bands == ["good", "fair", "fair", "poor"]
    labels = [one(spark, clinical.stability_label(F.lit(x).cast("boolean"))) for x in (True, False, None)]
    assert labels == ["Stable", "Unstable", ""]


def test_summary_of_single_reading_has_no_deviation(spark):
    row = report.summary_by_subject(values(spark, 100.04)).first()
    assert (row.n, row["mean"], row["std"]) == (1, 100.0, None)


def test_histogram(spark):
    rng = random.Random(3)
    numbers = [rng.uniform(40, 400) for _ in range(300)]
    df = values(spark, *numbers).unionByName(values(spark, 100, 100, subject="flat"))
    rows = report.glucose_histogram(df).collect()
    got = {s: [r.n for r in sorted(rows, key=lambda r: r.bin) if r.subject_id == s] for s in ("a", "flat")}
    low, high = min(numbers), max(numbers)
    want = [0] * 60
    for v in numbers:
        want[min(int((v - low) / (high - low) * 60), 59)] += 1
    assert got["a"] == want
    assert got["flat"] == [0] * 30 + [2] + [0] * 29


def test_correlation_by_present_pairs_and_constant_column(spark):
    rng = random.Random(4)
    rows = [
        (
            rng.gauss(150, 40) if rng.random() < 0.8 else None,
            rng.gauss(0, 1) if rng.random() < 0.7 else None,
            1.1,
            float(i) if i % 3 else None,
        )
        for i in range(400)
    ]
    names = ("p", "q", "same", "r")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(6)
    got = {(r.feature_x, r.feature_y): r.correlation for r in report.correlation_matrix(df, names).collect()}
    assert len(got) == 16
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if "same" in (x, y):
                assert got[x, y] is None
            else:
                want = statistics.correlation(*zip(*both)) if x != y else 1.0
                assert got[x, y] == pytest.approx(want, abs=1e-12)
