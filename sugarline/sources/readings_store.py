"""The readings table: immutable parquet files by date behind a manifest, last write wins on read.

A point is (subject, units, second). Writing one again appends a row; readers keep the row of
the latest write: by write number, then by the time its document was written, then by source and
position. A repeated write of the same rows therefore changes nothing. ``compact`` merges the dates
that were written since it last ran; the manifest notes them, as well as the last write number and,
for each stream, the last batch that is in the table.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sugarline import constants as C
from sugarline.functions import clinical
from sugarline.sources.manifest import Manifest, Table

SCHEMA = (
    "subject_id string, ts timestamp_ntz, glucose_mg_dl double, units string, source string, "
    "written_at timestamp, ingest_seq bigint, pos bigint, date date"
)
KEY = ("subject_id", "units", "ts")
WRITE_ORDER = ("ingest_seq", "written_at", "source", "pos")


#: A date that was appended to so often is merged, also if it holds no superseded rows.
MOST_COMMITS = 8


def table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "date", SCHEMA)


def next_seq(spark: SparkSession | None = None, path: str | None = None) -> int:
    """Default order of writes: wall-clock microseconds, but never below the last stored one."""
    manifest = table(spark, path).load() if spark is not None and path is not None else Manifest()
    return max(time.time_ns() // 1000, manifest.notes.get("last_seq", 0) + 1)


def to_points(readings: DataFrame, ingest_seq: int) -> DataFrame:
    """Readings as rows of the table. ``written_at`` is the document's time, where it is known."""
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    written = F.col("written_at") if "written_at" in readings.columns else F.lit(None)
    return readings.select(
        "subject_id",
        ts.alias("ts"),
        "glucose_mg_dl",
        "units",
        "source",
        written.cast("timestamp").alias("written_at"),
        F.lit(ingest_seq).cast("bigint").alias("ingest_seq"),
        "pos",
        F.to_date("ts").alias("date"),
    )


def write_readings(
    readings: DataFrame, path: str, ingest_seq: int | None = None, batch: tuple[str, int] | None = None
) -> bool:
    """Append readings; tells whether it did.

    ``batch`` names a stream and the number of its batch. A batch that is in the table already is
    not appended again: its number is committed in the same step as its rows.
    """
    store = table(readings.sparkSession, path)
    manifest = store.load()
    notes = manifest.notes
    batches = notes.setdefault("batches", {})
    if batch and batches.get(batch[0], -1) >= batch[1]:
        return False
    last = notes.get("last_seq", 0)
    seq = max(time.time_ns() // 1000, last + 1) if ingest_seq is None else ingest_seq
    commit, dates = store.write(to_points(readings, seq))
    if not dates and not batch:
        return True
    for date in dates:
        manifest.folders.setdefault(date, []).append(commit)
    notes["dirty"] = sorted({*notes.get("dirty", []), *dates})
    if dates:
        notes["last_seq"] = max(last, seq)
    if batch:
        batches[batch[0]] = batch[1]
    store.commit(manifest)
    return True


def read_points(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    between: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """All written rows, superseded ones included; none if the table was never written.

    The version is resolved here: later writes and compactions do not touch what is read. Only the
    dates ``between`` two days (both included) are listed, if given.
    """
    store = table(spark, path)
    manifest = store.load(version)
    if between is None:
        return store.read(manifest)
    first, last = between[0].isoformat(), between[1].isoformat()
    return store.read(manifest, [d for d in manifest.folders if first <= d <= last])


def dedup_latest_wins(points: DataFrame) -> DataFrame:
    """One row per point. Partial results combine before the shuffle, so copies never pile up."""
    return points.groupBy(*KEY).agg(
        F.max_by("glucose_mg_dl", F.struct(*WRITE_ORDER)).alias("glucose_mg_dl")
    )


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    return dedup_latest_wins(read_points(spark, path))


def last_hours(points: DataFrame, now: dt.datetime, hours: int) -> DataFrame:
    """Points of the ``hours`` before ``now``; the date condition prunes partitions."""
    if not C.MIN_HOURS <= hours <= C.MAX_HOURS:
        raise ValueError(f"hours must be between {C.MIN_HOURS} and {C.MAX_HOURS}, got {hours}")
    start = now - dt.timedelta(hours=hours)

    def moment(t: dt.datetime) -> Column:
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")

    return points.where(
        F.col("date").between(F.lit(start.date()), F.lit(now.date()))
        & (F.col("ts") >= moment(start))
        & (F.col("ts") < moment(now))
    )


def current_readings(
    spark: SparkSession,
    path: str,
    now: dt.datetime | None = None,
    hours: int = C.DEFAULT_HOURS,
    version: int | None = None,
) -> DataFrame:
    """Current readings of the last hours in no order; invalid values are left out."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    between = ((now - dt.timedelta(hours=hours)).date(), now.date())
    points = dedup_latest_wins(last_hours(read_points(spark, path, version, between), now, hours))
    return points.where(clinical.is_valid(F.col("glucose_mg_dl")))


def sort_latest(readings: DataFrame) -> DataFrame:
    return readings.orderBy("subject_id", "ts")


def latest_readings(
    spark: SparkSession,
    path: str,
    now: dt.datetime | None = None,
    hours: int = C.DEFAULT_HOURS,
) -> DataFrame:
    """Current readings of the last hours, by subject and time."""
    return sort_latest(current_readings(spark, path, now, hours))


def latest_documents(readings: DataFrame, hours: int) -> DataFrame:
    """Latest readings as one nested row per subject: hours requested, count, readings by time.

    A subject has one reading per second and unit at most, so the longest window holds 604,800.
    """
    entry = F.struct("ts", "glucose_mg_dl", "units")
    return readings.groupBy("subject_id").agg(
        F.lit(hours).alias("hours_requested"),
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_list(entry)).alias("readings"),
    )


def compact(spark: SparkSession, path: str) -> list[dt.date]:
    """Merge the dates written since the last time that hold superseded rows, or many small commits;
    returns them. Reads these dates only, and no date when nothing was written.

    The merged files stand in a commit of their own that takes the place of the others in the next
    manifest; readers of older versions keep their files.
    """
    store = table(spark, path)
    manifest = store.load()
    dirty = manifest.notes.get("dirty", [])
    if not dirty:
        return []
    points = store.read(manifest, dirty)
    counts = points.groupBy("date", *KEY).agg(F.count(F.lit(1)).alias("n"))
    stale = counts.where("n > 1").select("date").distinct()
    dates = {row.date.isoformat() for row in stale.collect()}  # one value per dirty day at most
    dates |= {d for d in dirty if len(manifest.folders[d]) > MOST_COMMITS}
    if dates:
        latest = (
            store.read(manifest, sorted(dates))
            .groupBy("date", *KEY)
            .agg(
                F.max_by(
                    F.struct("glucose_mg_dl", "source", "written_at", "ingest_seq", "pos"),
                    F.struct(*WRITE_ORDER),
                ).alias("p")
            )
            .select(*KEY, "p.*", "date")
        )
        commit, _ = store.write(latest)
        for date in dates:
            manifest.folders[date] = [commit]
    manifest.notes["dirty"] = []
    store.commit(manifest)
    return [dt.date.fromisoformat(d) for d in sorted(dates)]


def vacuum(spark: SparkSession, path: str, keep: int = 20) -> None:
    """Remove the files that none of the last ``keep`` versions names."""
    table(spark, path).vacuum(keep)
