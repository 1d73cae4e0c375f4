"""The feature table: events of many subjects in, one row per grid slot out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sugarline import constants as C
from sugarline.functions import clinical
from sugarline.operators import timeline
from sugarline.sources import features_table, xml_events

COLUMNS = (
    "ts",
    "glucose_mg_dl",
    "glucose_delta_1",
    "glucose_delta_3",
    "bolus_last_1h",
    "basal_rate",
    "carbs_last_1h",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "is_hypo",
    "is_hyper",
    "subject_id",
)


def build_feature_frame(
    events: DataFrame,
    cadence: int = C.CADENCE_SECONDS,
    chunk_bins: int = timeline.CHUNK_BINS,
) -> DataFrame:
    """Feature rows of all subjects of a long event table (see ``operators.timeline``).

    A subject without glucose yields no rows; an absent stream yields 0.0.
    """
    bins = timeline.resample(events, cadence, chunk_bins)
    rows = timeline.look_back(timeline.locate_bins(bins))
    glucose, ts = F.col("glucose"), timeline.bin_start(F.col("grid_bin"), cadence)
    derived = {
        "ts": ts,
        "glucose_mg_dl": glucose,
        **clinical.cyclical_time(ts),
        "is_hypo": clinical.is_hypo(glucose),
        "is_hyper": clinical.is_hyper(glucose),
    }
    return rows.select(*[derived[c].alias(c) if c in derived else c for c in COLUMNS])


def process_split(
    spark: SparkSession,
    raw_dir: str,
    split: str,
    cadence: int = C.CADENCE_SECONDS,
    in_parts: bool = False,
    in_pieces: bool = False,
) -> DataFrame:
    """Features of all subjects whose files belong to the split; empty when there are none.

    Each file has a grid of its own; the rows of a subject's files are stacked.
    """
    events = xml_events.read_split(spark, raw_dir, split, by_file=True, in_parts=in_parts, in_pieces=in_pieces)
    features = build_feature_frame(events, cadence)
    return features.withColumn("subject_id", xml_events.subject_of(F.col("subject_id")))


def process_raw(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    splits: tuple[str, ...] = C.SPLITS,
    cadence: int = C.CADENCE_SECONDS,
) -> list[str]:
    """Write the feature table of every split; returns the splits that have rows."""
    written = []
    for split in splits:
        if not xml_events.split_files_exist(spark, raw_dir, split):
            continue
        features = process_split(spark, raw_dir, split, cadence)
        if features_table.write_features(features, out_dir, split):
            written.append(split)
    return written
