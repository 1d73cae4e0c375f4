"""The stored feature table: immutable parquet files by split behind a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sugarline.sources.manifest import Table


def write_features(features: DataFrame, path: str, split: str) -> bool:
    """Replace one split if there are rows for it; tells whether there are.

    The rows become a commit that takes the split's place in the next manifest, and only if there
    are any. A crash at any step leaves the split before. What it replaced stays until
    :func:`vacuum`, so readers are not disturbed.
    """
    schema = features.withColumn("split", F.lit(split)).schema
    table = Table(features.sparkSession, path, "split", schema)
    manifest = table.load()
    commit, found = table.write(features.withColumn("split", F.lit(split)))
    if not found:
        return False
    manifest.folders[split] = [commit]
    manifest.notes["schema"] = schema.json()
    table.commit(manifest)
    return True


def _table(spark: SparkSession, path: str) -> Table:
    notes = Table(spark, path, "split", StructType()).load().notes
    return Table(spark, path, "split", StructType.fromJson(json.loads(notes["schema"])))


def read_features(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Feature rows with their ``split``; all splits together form the bag union of them."""
    table = _table(spark, path)
    return table.read(table.load(), list(splits) or None)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove the files that none of the last ``keep`` versions names."""
    _table(spark, path).vacuum(keep)


def union_splits(training: DataFrame, testing: DataFrame) -> DataFrame:
    return training.unionByName(testing)


def distinct_subjects(features: DataFrame) -> DataFrame:
    return features.select("subject_id").distinct().orderBy("subject_id")
