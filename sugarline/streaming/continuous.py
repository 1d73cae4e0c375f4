"""Continuous ingestion of JSON documents, and the latest view it keeps fresh.

The view does not copy readings. Its statistics come from moments per subject and hour, which a
refresh works out anew only for the dates that were written since the refresh before; the broken
hours at the windows' ends are read from the table.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sugarline import constants as C
from sugarline.functions import clinical
from sugarline.operators.statistics import client_statistics, mergeable_moments, merged_client_statistics
from sugarline.session import read_text
from sugarline.sources import json_docs, readings_store
from sugarline.sources.manifest import Manifest, Table

#: Documents of one micro-batch; a backlog is worked off in batches of this size.
FILES_PER_BATCH = 10_000
MOMENTS = (
    "subject_id string, hour timestamp_ntz, n bigint, low double, high double, in_range bigint, whole bigint, "
    "rest double, squares double, date date"
)
#: Files that no version named for so many refreshes are removed.
KEPT_VERSIONS = 20


def document_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New JSON documents of a folder, each a whole text, oldest first."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return json_docs.documents(files)


def stream_ingest(
    docs: DataFrame,
    store_path: str,
    checkpoint: str,
    subject: Column,
    available_now: bool = False,
    seq: Callable[[int], int] | None = None,
    after_batch: Callable[[SparkSession], None] | None = None,
    compact: bool = True,
) -> StreamingQuery:
    """Upsert the readings of every new document into the readings table.

    Documents may overlap and arrive late: a reading is an upsert at its own time, so there is
    no watermark and nothing is dropped. Within a batch the document that was written last wins.
    A batch that is replayed after a failure is not appended again: the table knows the last batch
    of each stream, by the id that Spark keeps in the checkpoint. ``compact`` merges the dates that
    the batch touched, and no others. Bad documents and entries give no rows;
    other errors end the query, which resumes from its checkpoint (see :func:`supervise`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]
        readings = json_docs.parse_documents(batch).withColumn("subject_id", subject)
        number = seq(batch_id) if seq else None
        readings_store.write_readings(readings, store_path, number, batch=(stream, batch_id))
        if compact:
            readings_store.compact(spark, store_path)
            if batch_id % KEPT_VERSIONS == 0:
                readings_store.vacuum(spark, store_path, 2 * KEPT_VERSIONS)
        if after_batch:
            after_batch(spark)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=C.REFRESH_INTERVAL).start()


def supervise(
    start: Callable[[], StreamingQuery], most_failures: int = 10, first_wait: float = 1.0, longest_wait: float = 300.0
) -> int:
    """Run a query until it stops by itself, starting it again after errors; returns the restarts.

    The wait doubles with each failure. The last error is raised after ``most_failures``.
    """
    failures = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except StreamingQueryException:
            failures += 1
            if failures >= most_failures:
                raise
            time.sleep(min(longest_wait, first_wait * 2 ** (failures - 1)))


def _view(spark: SparkSession, view_path: str) -> Table:
    return Table(spark, view_path, "date", MOMENTS)


def refresh_view(
    spark: SparkSession,
    store_path: str,
    view_path: str,
    now: dt.datetime | None = None,
    hours: tuple[int, ...] = C.VIEW_HOURS,
) -> None:
    """Bring the view's moments up to the table's last version and fix the view's time.

    Only dates whose files changed since the refresh before, and that lie in the widest window, are
    read. Readers find the version in the view's manifest, which is written last; versions before it
    stay readable.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    store, view = readings_store.table(spark, store_path), _view(spark, view_path)
    current, known = store.load(), view.load()
    first, last = (now - dt.timedelta(hours=max(hours))).date().isoformat(), now.date().isoformat()
    seen = known.notes.get("seen", {})
    wanted = {d: commits for d, commits in current.folders.items() if first <= d <= last}
    changed = sorted(d for d, commits in wanted.items() if commits != seen.get(d))
    if changed:
        points = readings_store.dedup_latest_wins(store.read(current, changed))
        valid = points.where(clinical.is_valid(F.col("glucose_mg_dl")))
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
        moments = mergeable_moments(valid.select("subject_id", "glucose_mg_dl", hour), "subject_id", "hour")
        commit, written = view.write(moments.withColumn("date", F.to_date("hour")))
        for date in changed:
            known.folders[date] = [commit] if date in written else []
    known.folders = {d: commits for d, commits in known.folders.items() if d in wanted and commits}
    known.notes = {
        "seen": wanted, "store": current.version, "store_path": store_path, "now": now.isoformat(sep=" "), "hours": list(hours),
    }
    view.commit(known)
    if known.version % KEPT_VERSIONS == 0:
        view.vacuum(KEPT_VERSIONS)


def view_statistics(
    readings: DataFrame, now: dt.datetime, hours: tuple[int, ...] = C.VIEW_HOURS
) -> DataFrame:
    """Display statistics per window and subject, all windows in one pass over readings."""
    return client_statistics(_spread(readings, "ts", now, hours), "hours", "subject_id")


def _spread(rows: DataFrame, time: str, now: dt.datetime, hours: tuple[int, ...]) -> DataFrame:
    """The rows once for each window that reaches back to them."""
    age = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") - F.col(time)
    windows = F.filter(
        F.array(*[F.lit(h) for h in hours]),
        lambda h: age <= F.make_dt_interval(hours=h),
    )
    return rows.select("*", F.explode(windows).alias("hours"))


def latest_view(spark: SparkSession, view_path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Readings and statistics as of a refresh, by default the last."""
    view = _view(spark, view_path)
    manifest = view.load(version)
    notes = manifest.notes
    store_path, now, hours = notes["store_path"], dt.datetime.fromisoformat(notes["now"]), tuple(notes["hours"])
    readings = readings_store.current_readings(spark, store_path, now, max(hours), notes["store"])

    def moment(t: dt.datetime):
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")

    # Whole hours before the one that is not over yet, then the broken hours at the windows' ends
    this_hour = now.replace(minute=0, second=0, microsecond=0)
    whole = view.read(manifest).where(F.col("hour") < moment(this_hour))
    parts = [_spread(whole, "hour", now, hours)]
    broken = [(this_hour, now, hours)]
    for h in hours:
        start = now - dt.timedelta(hours=h)
        if start != start.replace(minute=0, second=0, microsecond=0):
            end = start.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
            broken.append((start, end, (h,)))
    for start, end, own in broken:
        if start < end:
            between = (start.date(), end.date())
            points = readings_store.read_points(spark, store_path, notes["store"], between)
            points = points.where((F.col("ts") >= moment(start)) & (F.col("ts") < moment(end)))
            points = points.where(F.col("date").between(F.lit(between[0]), F.lit(between[1])))
            valid = readings_store.dedup_latest_wins(points).where(clinical.is_valid(F.col("glucose_mg_dl")))
            sums = mergeable_moments(valid.withColumn("hour", F.lit(None).cast("timestamp_ntz")), "subject_id", "hour")
            listed = F.explode(F.array(*[F.lit(h) for h in own])).alias("hours")
            parts.append(sums.withColumn("date", F.lit(None).cast("date")).select("*", listed))
    moments = parts[0]
    for part in parts[1:]:
        moments = moments.unionByName(part)
    return readings, merged_client_statistics(moments, "hours", "subject_id")
