"""The exploratory report: small result tables over the stored feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sugarline.operators import report
from sugarline.sources.features_table import distinct_subjects

TRAINING = "training"


def eda_tables(features: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report. ``features`` carries its ``split``; correlations, missing
    values and the summary look at the training split only."""
    training = features.where(F.col("split") == TRAINING)
    return {
        "profile": report.dataset_profile(features),
        "subjects": distinct_subjects(features),
        "histogram": report.glucose_histogram(features),
        "zones": report.zone_breakdown(features),
        "correlation": report.correlation_matrix(training),
        "missing": report.missing_percent(training),
        "hypo": report.hypo_prevalence(features),
        "summary": report.summary_by_subject(training),
    }


def eda_report(features: DataFrame) -> DataFrame:
    """All tables as one long table: section, item, metric, value; times are seconds of the epoch."""

    def long(table: DataFrame, section: str, item: Column, metrics: list[str]) -> DataFrame:
        rows = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                for m in metrics
            ]
        )
        return table.select(F.lit(section).alias("section"), item.alias("item"), F.inline(rows))

    tables = eda_tables(features)
    epoch = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    profile = tables["profile"].withColumns({"first_ts": epoch("first_ts"), "last_ts": epoch("last_ts")})
    subjects = tables["subjects"].withColumn("present", F.lit(1))
    histogram = tables["histogram"]
    slot = F.concat_ws(" ", "subject_id", "bin")
    pair = F.concat_ws(" ~ ", "feature_x", "feature_y")
    zones = [c for c in tables["zones"].columns if c != "subject_id"]
    parts = [
        long(profile, "profile", F.col("part"), ["rows", "columns", "subjects", "first_ts", "last_ts"]),
        long(subjects, "subjects", F.col("subject_id"), ["present"]),
        long(histogram, "histogram", slot, ["bin_start", "n", "mean_glucose"]),
        long(tables["zones"], "zones", F.col("subject_id"), zones),
        long(tables["correlation"], "correlation", pair, ["correlation"]),
        long(tables["missing"], "missing", F.col("feature"), ["missing_percent"]),
        long(
            tables["hypo"], "hypo", F.col("subject_id"), ["hypo_percent", "severe_percent", "n"]
        ),
        long(
            tables["summary"],
            "summary",
            F.col("subject_id"),
            ["n", "mean", "std", "min", "max"],
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
