"""Report tables over the feature table. All are grouped aggregates with map-side partials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sugarline import constants as C
from sugarline.functions.clinical import in_range
from sugarline.functions.exact import exact_avg
from sugarline.functions.rounding import scaled_rint
from sugarline.session import ship_package

GLUCOSE = "glucose_mg_dl"
TOTAL = "total"


def _percent(condition: Column) -> Column:
    return F.try_divide(F.count_if(condition), F.count(F.lit(1))) * 100


def zone_breakdown(features: DataFrame) -> DataFrame:
    """Percent of a subject's readings in each of the five zones."""
    v = F.col(GLUCOSE)
    zones = {
        "severe_hypo_percent": v < C.SEVERE_HYPO_BELOW,
        "hypo_percent": (v >= C.SEVERE_HYPO_BELOW) & (v < C.HYPO_BELOW),
        "in_range_percent": in_range(v),
        "hyper_percent": (v > C.HYPER_ABOVE) & (v <= C.SEVERE_HYPER_ABOVE),
        "severe_hyper_percent": v > C.SEVERE_HYPER_ABOVE,
    }
    return (
        features.where(v.isNotNull())
        .groupBy("subject_id")
        .agg(*[scaled_rint(_percent(zone), 1).alias(name) for name, zone in zones.items()])
    )


def hypo_prevalence(features: DataFrame) -> DataFrame:
    """Percent of a subject's readings below the two lower bounds, and their number."""
    v = F.col(GLUCOSE)
    return (
        features.where(v.isNotNull())
        .groupBy("subject_id")
        .agg(
            scaled_rint(_percent(v < C.HYPO_BELOW), 1).alias("hypo_percent"),
            scaled_rint(_percent(v < C.SEVERE_HYPO_BELOW), 1).alias("severe_percent"),
            F.count(v).alias("n"),
        )
    )


def summary_by_subject(features: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and extremes of a subject, one decimal."""
    v = F.col(GLUCOSE)
    figures = {
        "mean": exact_avg(GLUCOSE),
        "std": F.stddev_samp(v),
        "min": F.min(v),
        "max": F.max(v),
    }
    return features.groupBy("subject_id").agg(
        F.count(v).alias("n"),
        *[scaled_rint(figure, 1).alias(name) for name, figure in figures.items()],
    )


GRAM = "present int, n bigint, mean array<double>, low array<double>, high array<double>, covar array<double>"


class _Moments:
    """Count, means, extremes and co-moments of rows that have the same columns."""

    def __init__(self, rows: np.ndarray):
        self.n, self.mean = len(rows), rows.mean(axis=0)
        centred = rows - self.mean
        self.products = centred.T @ centred
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)

    def add(self, other: _Moments) -> None:
        """Co-moments add up, plus the spread of the two means."""
        total = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / total)
        self.mean = self.mean + apart * (other.n / total)
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        self.n = total


def gram_moments(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Moments of the rows of each task by the pattern of columns that are present.

    A batch is centred once for each pattern, and one matrix product gives all its co-moments. A
    task sends a row for each pattern, so 2^columns at most.
    """
    ship_package(features.sparkSession)
    k = len(columns)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            patterns = there @ (1 << np.arange(k))
            for pattern in np.unique(patterns).tolist():
                own = [i for i in range(k) if pattern >> i & 1]
                found = _Moments(values[patterns == pattern][:, own])
                if pattern in held:
                    held[pattern].add(found)
                else:
                    held[pattern] = found
        rows = []
        for pattern, m in held.items():
            own = [i for i in range(k) if pattern >> i & 1]
            wide = {name: np.full(k, np.nan) for name in ("mean", "low", "high")}
            for name, column in wide.items():
                column[own] = getattr(m, name)
            covar = np.full((k, k), np.nan)
            covar[np.ix_(own, own)] = m.products / m.n
            rows.append((pattern, m.n, *wide.values(), covar.ravel()))
        kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 4]
        names = [f.split()[0] for f in GRAM.split(", ")]
        data = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds, strict=True)], names=names)

    return features.select(*[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(columns)]).mapInArrow(collect, GRAM)


def correlation_matrix(features: DataFrame, columns: tuple[str, ...] = C.FEATURES) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are present.

    Rows are grouped by which columns they have; inside such a group every pair is complete, and
    one matrix product takes all co-moments. The groups of a pair are then merged exactly:
    co-moments add up, plus the spread of the group means. A constant column gives NULL.
    """
    places = range(len(columns))

    def column(i: int) -> str:
        covar = f"slice(covar, {i * len(columns) + 1}, {len(columns)}) AS covar"
        figures = f"struct(n, mean[{i}] AS mean, low[{i}] AS low, high[{i}] AS high, {covar})"
        return f"IF((present & {1 << i}) = 0, NULL, {figures})"

    moments = gram_moments(features, columns)
    by_column = moments.selectExpr(f"array({', '.join(column(i) for i in places)}) AS by_column")
    names = ", ".join(f"'{c}'" for c in columns)
    cells = (
        by_column.selectExpr("by_column", f"posexplode(array({names})) AS (i, feature_x)")
        .selectExpr("*", f"posexplode(array({names})) AS (j, feature_y)")
        .selectExpr("*", "by_column[i] AS a", "by_column[j] AS b")
        .selectExpr(
            "feature_x",
            "feature_y",
            "i",
            "j",
            "a",
            "b",
            "IF(a IS NOT NULL AND b IS NOT NULL, a.n, NULL) AS n",
        )
    )
    over = "OVER (PARTITION BY feature_x, feature_y)"
    cells = cells.selectExpr(
        "*",
        f"try_divide(sum(n * a.mean) {over}, sum(n) {over}) AS mean_a",
        f"try_divide(sum(n * b.mean) {over}, sum(n) {over}) AS mean_b",
    )
    xy = "sum(n * (a.covar[j] + (a.mean - mean_a) * (b.mean - mean_b)))"
    xx = "sum(n * (a.covar[i] + (a.mean - mean_a) * (a.mean - mean_a)))"
    yy = "sum(n * (b.covar[j] + (b.mean - mean_b) * (b.mean - mean_b)))"
    varies = " AND ".join(
        f"min(IF(n IS NULL, NULL, {side}.low)) < max(IF(n IS NULL, NULL, {side}.high))"
        for side in ("a", "b")
    )
    return cells.groupBy("feature_x", "feature_y").agg(
        F.expr(
            f"CASE WHEN NOT ({varies}) THEN NULL WHEN feature_x = feature_y THEN 1D"
            f" ELSE try_divide({xy}, sqrt({xx} * {yy})) END AS correlation"
        )
    )


def missing_percent(features: DataFrame, columns: tuple[str, ...] = C.FEATURES) -> DataFrame:
    """Percent of missing values per column, all columns in one pass."""
    shares = features.agg(*[_percent(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_percent"))
            for c in columns
        ]
    )
    return shares.select(F.inline(rows))


def glucose_histogram(features: DataFrame, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per subject from its minimum to its maximum, empty bins included.

    The last bin is closed; equal extremes widen the range by 0.5 on both sides. One scan gives the
    range of each subject, a second one counts by bin; both combine on the map side, so a task
    sends one row, or one per bin, for a subject. The range comes back by a join that adaptive
    execution broadcasts when the ranges are measured to be small, and otherwise runs as a
    sort-merge join whose oversized partitions it splits.
    """
    readings = features.where(F.col(GLUCOSE).isNotNull()).select("subject_id", F.col(GLUCOSE).alias("value"))
    ranges = readings.groupBy("subject_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), exact_avg("value").alias("mean_glucose")
    )
    flat = F.col("low") == F.col("high")
    ranges = ranges.select(
        "subject_id",
        "mean_glucose",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    position = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins
    keys = ["subject_id", "low", "high", "mean_glucose"]
    counted = (
        readings.join(ranges, "subject_id")
        .groupBy(*keys, F.least(F.floor(position), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most `bins` entries per subject
    filled = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    width = (F.col("high") - F.col("low")) / bins
    return filled.select("*", every).select(
        "subject_id",
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)).alias("n"),
        "mean_glucose",
    )


def dataset_profile(features: DataFrame) -> DataFrame:
    """Rows, columns, distinct subjects and time span per split and in total."""
    per_subject = features.groupBy("split", "subject_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    labels = F.explode(F.array(F.col("split"), F.lit(TOTAL))).alias("part")
    return (
        per_subject.select("*", labels)
        .groupBy("part", "subject_id")
        .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("part")
        .agg(
            F.sum("rows").alias("rows"),
            F.count("subject_id").alias("subjects"),
            F.min("first").alias("first_ts"),
            F.max("last").alias("last_ts"),
        )
        .select(
            "part",
            "rows",
            F.lit(len([c for c in features.columns if c != "split"])).alias("columns"),
            "subjects",
            "first_ts",
            "last_ts",
        )
    )
