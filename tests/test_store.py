"""The manifest behind the tables: what writes read, open readers, crashes, replays, the view."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sugarline import constants as C
from sugarline.sources import features_table, readings_store
from sugarline.sources.manifest import Table
from sugarline.streaming import continuous
from tests.test_sources import readings
from tests.test_streaming import document

T = dt.datetime(2024, 1, 1, 10)


def day(n):
    return T + dt.timedelta(days=n)


def files(path, date):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f"date={date}" in d and f.endswith(".parquet")]


def current(spark, path):
    return sorted((r.subject_id, r.ts, r.glucose_mg_dl) for r in readings_store.read_readings(spark, path).collect())


def test_a_write_and_its_compaction_read_the_touched_date_only(spark, tmp_path):
    path = str(tmp_path / "store")
    for seq in (1, 2):
        readings_store.write_readings(readings(spark, *[("a", day(n), 100.0 + seq, n) for n in range(5)]), path, seq)
    assert len(readings_store.compact(spark, path)) == 5
    # Whoever opened a file of another date would fail
    for n in (0, 1, 3, 4):
        for file in files(path, day(n).date()):
            os.truncate(file, 0)
    readings_store.write_readings(readings(spark, ("a", day(2), 150.0, 0), ("b", day(2), 60.0, 1)), path)
    assert readings_store.compact(spark, path) == [day(2).date()]
    latest = readings_store.latest_readings(spark, path, day(2) + dt.timedelta(hours=1), 2)
    assert [(r.subject_id, r.glucose_mg_dl) for r in latest.collect()] == [("a", 150.0), ("b", 60.0)]
    assert readings_store.compact(spark, path) == []


def test_small_commits_are_merged(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(readings_store.MOST_COMMITS + 1):
        readings_store.write_readings(readings(spark, (f"s{i}", T, 100.0, 0)), path)
    assert readings_store.compact(spark, path) == [T.date()]
    assert len(readings_store.table(spark, path).load().folders["2024-01-01"]) == 1
    assert len(current(spark, path)) == readings_store.MOST_COMMITS + 1


def test_an_open_reader_ends_with_its_old_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    readings_store.write_readings(readings(spark, ("a", T, 100.0, 0), ("b", day(1), 90.0, 1)), path, 1)
    readings_store.write_readings(readings(spark, ("a", T, 110.0, 0)), path, 2)
    before = readings_store.read_points(spark, path)
    readings_store.compact(spark, path)
    readings_store.write_readings(readings(spark, ("a", T, 120.0, 0)), path, 3)
    readings_store.compact(spark, path)
    assert sorted(r.glucose_mg_dl for r in before.collect()) == [90.0, 100.0, 110.0]
    assert [v for _, _, v in current(spark, path)] == [120.0, 90.0]
    readings_store.vacuum(spark, path, 1)
    assert [v for _, _, v in current(spark, path)] == [120.0, 90.0]
    assert len(files(path, "2024-01-01")) == 1 and len(readings_store.table(spark, path).versions()) == 1


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_crash_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    for seq in (1, 2):
        readings_store.write_readings(readings(spark, ("a", T, 100.0 + seq, 0), ("b", day(1), 90.0, 1)), path, seq)
    features = readings(spark, ("a", T, 1.0, 0))
    table = str(tmp_path / "features")
    features_table.write_features(features, table, "training")
    before = current(spark, path)
    whole = getattr(Table, step)

    def crash(self, *args):
        if step == "write":
            whole(self, *args)
        raise RuntimeError("power is gone")

    with monkeypatch.context() as m:
        m.setattr(Table, step, crash)
        for action in (
            lambda: readings_store.write_readings(readings(spark, ("a", T, 5.0, 0)), path, 3),
            lambda: readings_store.compact(spark, path),
            lambda: features_table.write_features(features.withColumn("glucose_mg_dl", F.lit(2.0)), table, "training"),
        ):
            with pytest.raises(RuntimeError):
                action()
    assert current(spark, path) == before
    assert [r.glucose_mg_dl for r in features_table.read_features(spark, table).collect()] == [1.0]
    assert len(readings_store.compact(spark, path)) == 2
    assert current(spark, path) == before


def test_features_are_replaced_by_split(spark, tmp_path):
    table = str(tmp_path / "features")
    for value, split in ((1.0, "training"), (2.0, "testing"), (3.0, "training")):
        assert features_table.write_features(readings(spark, ("a", T, value, 0)), table, split)
    assert not features_table.write_features(readings(spark, ("a", T, 9.0, 0)).limit(0), table, "testing")
    features_table.vacuum(spark, table, 1)
    rows = features_table.read_features(spark, table).collect()
    assert sorted((r.split, r.glucose_mg_dl) for r in rows) == [("testing", 2.0), ("training", 3.0)]
    assert features_table.read_features(spark, table, "testing").count() == 1


def test_a_second_writer_of_a_version_gets_an_error(spark, tmp_path):
    store = readings_store.table(spark, str(tmp_path / "store"))
    one, two = store.load(), store.load()
    store.commit(one)
    with pytest.raises(FileExistsError):
        store.commit(two)


def test_a_killed_and_resumed_batch_is_stored_once(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    left = [2]

    def fail_twice(_):
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("killed after the write")

    def start(checkpoint="cp"):
        docs = continuous.document_stream(spark, str(inbox))
        return continuous.stream_ingest(
            docs, store, str(tmp_path / checkpoint), F.lit("me"), True, after_batch=fail_twice, compact=False
        )

    (inbox / "a.json").write_text(document((1741500000000, 120), (1741500300000, 121)))
    assert continuous.supervise(start, first_wait=0.01) == 2
    assert readings_store.read_points(spark, store).count() == 2
    (inbox / "b.json").write_text(document((1741500300000, 122)))
    start().awaitTermination()
    assert readings_store.read_points(spark, store).count() == 3
    # A new checkpoint is another stream: its batches count from 0 again and are no replays
    start("other").awaitTermination()
    assert readings_store.read_points(spark, store).count() == 6
    assert [v for _, _, v in current(spark, store)] == [120.0, 122.0]


@pytest.mark.parametrize("now", [dt.datetime(2024, 1, 9, 12), dt.datetime(2024, 1, 9, 12, 34, 56)])
def test_the_view_equals_statistics_of_the_readings(spark, tmp_path, now):
    rng = random.Random(6)
    store, view = str(tmp_path / "store"), str(tmp_path / "view")
    for batch in range(3):
        rows = [
            (rng.choice("abc"), now - dt.timedelta(seconds=rng.randint(-9000, 8 * 86400)), rng.choice([rng.uniform(30, 420), 900.0, 70.0]), i)
            for i in range(300)
        ]
        readings_store.write_readings(readings(spark, *rows), store)
        if batch:
            readings_store.compact(spark, store)
        continuous.refresh_view(spark, store, view, now + dt.timedelta(minutes=batch))
        got_readings, got = continuous.latest_view(spark, view)
        at = now + dt.timedelta(minutes=batch)
        want = readings_store.current_readings(spark, store, at, max(C.VIEW_HOURS))
        assert got_readings.count() == want.count()
        assert sorted(got.collect()) == sorted(continuous.view_statistics(want, at).select(got.columns).collect())


def test_a_refresh_reads_the_written_dates_only(spark, tmp_path):
    store, view = str(tmp_path / "store"), str(tmp_path / "view")
    readings_store.write_readings(readings(spark, *[("a", day(n), 100.0, n) for n in range(7)]), store)
    now = day(6) + dt.timedelta(minutes=30)
    continuous.refresh_view(spark, store, view, now)
    for n in range(1, 6):
        for file in files(store, day(n).date()):
            os.truncate(file, 0)
    readings_store.write_readings(readings(spark, ("b", day(6), 50.0, 0)), store)
    continuous.refresh_view(spark, store, view, now)
    _, statistics = continuous.latest_view(spark, view)
    counts = {(r.hours, r.subject_id): r["count"] for r in statistics.collect()}
    assert counts[168, "a"] == 7 and counts[24, "b"] == 1
