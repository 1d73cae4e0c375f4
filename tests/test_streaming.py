import datetime as dt
import os

from pyspark.sql import functions as F

from sugarline.sources import readings_store
from sugarline.streaming import continuous

NOW = dt.datetime(2025, 3, 10)


def document(*entries):
    return '{"sgs":[%s]}' % ",".join(f'{{"timestamp":{t},"sg":{v}}}' for t, v in entries)


def run(spark, folder, store, checkpoint, **kwargs):
    stream = continuous.stream_ingest(
        continuous.document_stream(spark, str(folder)),
        str(store),
        str(checkpoint),
        F.lit("me"),
        available_now=True,
        **kwargs,
    )
    stream.awaitTermination()


def test_overlapping_documents_and_replay(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store, checkpoint, view = tmp_path / "store", tmp_path / "cp", tmp_path / "view"
    t0 = 1741500000000
    (inbox / "a.json").write_text(document((t0, 120), (t0 + 300000, 115)))
    refresh = lambda s: continuous.refresh_view(s, str(store), str(view), NOW)
    run(spark, inbox, store, checkpoint, after_batch=refresh)
    (inbox / "b.json").write_text(document((t0 + 300000, 116), (t0 + 600000, 60)))
    (inbox / "bad.json").write_text('{"sgs":')
    run(spark, inbox, store, checkpoint, after_batch=refresh)

    def current():
        rows = readings_store.read_readings(spark, str(store)).orderBy("ts").collect()
        return [r.glucose_mg_dl for r in rows]

    assert current() == [120.0, 116.0, 60.0]
    readings, statistics = continuous.latest_view(spark, str(view))
    assert readings.count() == 3
    by_hours = {r.hours: r for r in statistics.collect()}
    assert set(by_hours) == {24, 72, 168}
    assert by_hours[24]["count"] == 3 and by_hours[24].time_in_range_percent == 66.7

    # The same documents once more, as after a lost checkpoint: later writes of equal values
    # in file order; the overlapping point keeps one of the two delivered values
    run(spark, inbox, store, tmp_path / "cp2")
    assert readings_store.read_readings(spark, str(store)).count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(document((1741500000000, 120)))
    for checkpoint in ("one", "two"):
        run(spark, inbox, tmp_path / "store", tmp_path / checkpoint, seq=lambda batch_id: batch_id)
    rows = readings_store.read_points(spark, str(tmp_path / "store"))
    assert rows.count() == 1
    assert readings_store.dedup_latest_wins(rows).count() == 1


def test_the_document_written_last_wins(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, value, when in (("z", 111, 1_700_000_000), ("m", 150, 1_700_000_100), ("a", 222, 1_700_000_200)):
        (inbox / f"{name}.json").write_text(document((1741500000000, value)))
        os.utime(inbox / f"{name}.json", (when, when))
    run(spark, inbox, tmp_path / "store", tmp_path / "cp")
    assert [r.glucose_mg_dl for r in readings_store.read_readings(spark, str(tmp_path / "store")).collect()] == [222.0]


def test_a_failed_cycle_is_started_again(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(document((1741500000000, 120)))
    left = [2]

    def fail_twice(_):
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("a failure")

    def start():
        docs = continuous.document_stream(spark, str(inbox))
        return continuous.stream_ingest(
            docs, str(tmp_path / "store"), str(tmp_path / "cp"), F.lit("me"), available_now=True, after_batch=fail_twice
        )

    assert continuous.supervise(start, first_wait=0.01) == 2
    assert readings_store.read_readings(spark, str(tmp_path / "store")).count() == 1
