import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sugarline.plans import ingest
from sugarline.plans.features import process_raw
from sugarline.sources import csv_export, features_table, json_docs, readings_store, xml_events

HEADER = "Index,Date,Time,BG Source,Sensor Glucose (mg/dL)\n"
ROWS = "0,2026/03/06,08:00:00,,120\n1,2026/03/06,08:05:00,,118\n2,2026/03/06,08:10:00,,115\n"


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding, newline="")
    return path


def csv_values(spark, folder):
    rows = csv_export.read_cgm_csv(spark, str(folder)).orderBy("source", "pos").collect()
    return [(r.subject_id, r.glucose_mg_dl) for r in rows]


def test_preamble_and_rows(spark, tmp_path):
    write(tmp_path, "p1.csv", "Device: pump\nSerial: ABC123\n" + HEADER + ROWS, "utf-8-sig")
    rows = csv_export.read_cgm_csv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.glucose_mg_dl for r in rows] == [120.0, 118.0, 115.0]
    assert rows[0].ts == dt.datetime(2026, 3, 6, 8) and rows[0].units == "mg/dL"
    assert rows[0].subject_id == "p1"


def test_bom_before_header(spark, tmp_path):
    write(tmp_path, "p1.csv", "Sensor Glucose (mg/dL),Date,Time\n7,2026/3/6,8:0:0\n", "utf-8-sig")
    assert csv_values(spark, tmp_path) == [("p1", 7.0)]


def test_bad_rows_are_skipped(spark, tmp_path):
    bad = "1,INVALID,INVALID,,not_a_number\n1,2026/03/06,08:05:00,,  \n1,2026/03/06\n\n"
    write(tmp_path, "p1.csv", "9,2026/03/06,07:00:00,,99\n" + HEADER + bad + ROWS)
    assert [v for _, v in csv_values(spark, tmp_path)] == [120.0, 118.0, 115.0]


def test_sentinels_and_line_ends(spark, tmp_path):
    text = HEADER + "0,2026/03/06,08:00:00,,Low\n1,2026/03/06,08:05:00,,High\n"
    write(tmp_path, "p1.csv", text.replace("\n", "\r\n"))
    assert [v for _, v in csv_values(spark, tmp_path)] == [39.0, 401.0]


def test_repeated_header_moves_columns_and_quoted_cells(spark, tmp_path):
    second = 'Time,"Sensor Glucose (mg/dL)",Note,Date\n08:15:00,90,"a, ""b"", c",2026/03/06\n'
    inch = '08:20:00,91,5" tall,2026/03/06\n'
    write(tmp_path, "p1.csv", HEADER + ROWS + "preamble again\n" + second + inch)
    assert [v for _, v in csv_values(spark, tmp_path)] == [120.0, 118.0, 115.0, 90.0, 91.0]


def test_header_without_date_rejects_the_file(spark, tmp_path):
    write(tmp_path, "bad.csv", HEADER + ROWS + "Index,Time,Sensor Glucose (mg/dL)\n")
    write(tmp_path, "good.csv", HEADER + ROWS)
    assert {s for s, _ in csv_values(spark, tmp_path)} == {"good"}


def test_header_carries_over_read_splits(spark, tmp_path):
    """Files are read in pieces; a piece without a header takes that of the pieces before."""
    body = "".join(f"{i},2026/03/{1 + i // 1440:02d},{i // 60 % 24:02d}:{i % 60:02d}:00,,{100 + i % 50}\n" for i in range(3000))
    other = "Time,Date,Sensor Glucose (mg/dL)\n" + "10:00:00,2026/04/01,77\n" * 300
    write(tmp_path, "p1.csv", HEADER + body + other)
    write(tmp_path, "p2.csv", "preamble\n" * 500 + HEADER + ROWS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = csv_export.read_lines(spark, str(tmp_path))
        assert lines.select("source", "block").distinct().count() > 20
        got = csv_values(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    p1 = [v for s, v in got if s == "p1"]
    assert p1 == [100.0 + i % 50 for i in range(3000)] + [77.0] * 300
    assert [v for s, v in got if s == "p2"] == [120.0, 118.0, 115.0]


def test_documents_held_as_text(spark):
    docs = spark.createDataFrame([("/x/a.csv", "﻿" + HEADER + ROWS)], "source string, text string")
    assert csv_export.parse_lines(csv_export.document_lines(docs)).count() == 3


@pytest.mark.parametrize(
    "text,count",
    [
        ('{"sgs":[{"timestamp":1741500000000,"sg":120},{"timestamp":1741500300000,"sg":"115"}]}', 2),
        ('{"sgs":[{"timestamp":1741500000000,"sg":0},{"timestamp":1741500300000,"sg":120}]}', 1),
        ('{"sgs":[]}', 0),
        ('{"sgs":null}', 0),
        ("{}", 0),
        ("not json", 0),
        ('{"sgs":[{"timestamp":"1741500000000","sg":120},{"sg":3},{"timestamp":5},null,7]}', 0),
        ('{"sgs":[{"timestamp":1741500000000,"sg":-5},{"timestamp":1e30,"sg":5}]}', 0),
    ],
)
def test_json_documents(spark, tmp_path, text, count):
    write(tmp_path, "d.json", text)
    rows = json_docs.read_cgm_json(spark, str(tmp_path)).orderBy("pos").collect()
    assert len(rows) == count
    if count == 2:
        assert [r.glucose_mg_dl for r in rows] == [120.0, 115.0]
        assert rows[0].ts == dt.datetime(2025, 3, 9, 6, 0)


XML = """<?xml version="1.0"?>
<patient id="559">
<glucose_level>
  <event ts="01-12-2021 00:01:00" value="100"/><event ts="1-12-2021 0:06:00" value="110"/>
  <event ts="01-12-2021 00:11:00" value=""/><event ts="oops" value="1"/>
</glucose_level>
<bolus>
  <event ts_begin="01-12-2021 00:02:00" ts="x" dose="1.5" type="square"/>
  <event ts="01-12-2021 00:03:00" dose="2"/><event ts_begin="" ts="01-12-2021 00:04:00" dose="3" type=""/>
</bolus>
<basal><event ts="01-12-2021 00:00:00" value="0.8"/></basal>
<meal></meal>
<exercise><event ts="01-12-2021 00:00:00" value="5"/></exercise>
<glucose_level><event ts="01-12-2021 00:16:00" value="130"/></glucose_level>
</patient>
"""


def test_xml_streams(spark, tmp_path):
    write(tmp_path, "559-ws-training.xml", XML)
    write(tmp_path, "570-ws-testing.xml", XML)
    events = xml_events.read_split(spark, str(tmp_path), "training")
    assert [r.glucose_mg_dl for r in xml_events.glucose_events(events).orderBy("timestamp").collect()] == [100.0, 110.0, 130.0]
    bolus = xml_events.bolus_events(events).orderBy("timestamp").collect()
    assert [(r.bolus_dose_u, r.bolus_type) for r in bolus] == [(1.5, "square"), (2.0, "normal"), (3.0, "")]
    assert xml_events.basal_events(events).first().basal_rate_u_hr == 0.8
    assert xml_events.meal_events(events).count() == 0
    assert {r.subject_id for r in events.collect()} == {"559"}
    files = xml_events.discover_split_files(spark, str(tmp_path), "testing").collect()
    assert [r.subject_id for r in files] == ["570"]


def test_feature_files_per_split(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    write(raw, "559-ws-training.xml", XML)
    write(raw, "560-ws-training.xml", XML.replace("glucose_level", "other"))
    assert xml_events.read_split(spark, str(raw), "testing").count() == 0
    assert process_raw(spark, str(raw), str(out)) == ["training"]
    rows = features_table.read_features(spark, str(out), "training").orderBy("ts").collect()
    assert [r.glucose_mg_dl for r in rows] == [100.0, 110.0, 120.0, 130.0]
    assert [r.bolus_last_1h for r in rows] == [6.5, 6.5, 6.5, 6.5]
    assert {r.subject_id for r in rows} == {"559"} and rows[0].basal_rate == 0.8


def readings(spark, *rows):
    schema = "subject_id string, ts timestamp_ntz, glucose_mg_dl double, pos bigint"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("units", F.lit("mg/dL")).withColumn("source", F.lit("s"))


def test_store_counts_and_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    t = dt.datetime(2024, 1, 1, 10, 0, 0, 250000)
    first = readings(spark, ("a", t, 100.0, 0), ("a", t.replace(microsecond=900000), 101.0, 1), ("b", t, 90.0, 2))
    assert readings_store.read_readings(spark, path).count() == 0
    assert readings_store.latest_readings(spark, path, t).count() == 0
    readings_store.write_readings(first, path, 1)
    assert readings_store.read_points(spark, path).count() == 3
    readings_store.write_readings(first.limit(0), path, 2)
    assert readings_store.read_points(spark, path).count() == 3
    second = readings(spark, ("b", t, 95.0, 0), ("a", t + dt.timedelta(days=1), 700.0, 1))
    readings_store.write_readings(second, path, 3)
    for _ in range(2):  # a repeated write changes nothing
        got = {(r.subject_id, r.ts.day): r.glucose_mg_dl for r in readings_store.read_readings(spark, path).collect()}
        assert got == {("a", 1): 101.0, ("b", 1): 95.0, ("a", 2): 700.0}
        readings_store.write_readings(second, path, 3)
    before = sorted(readings_store.read_readings(spark, path).collect())
    assert [d.day for d in readings_store.compact(spark, path)] == [1, 2]
    assert readings_store.compact(spark, path) == []
    assert readings_store.read_points(spark, path).count() == 3
    assert sorted(readings_store.read_readings(spark, path).collect()) == before
    assert readings_store.next_seq(spark, path) > 3
    readings_store.write_readings(second.limit(1), path, 2**62)
    assert readings_store.next_seq(spark, path) == 2**62 + 1


def test_latest_readings(spark, tmp_path):
    path = str(tmp_path / "store")
    now = dt.datetime(2024, 1, 10, 12)
    ages = [0, 1, 24, 25, 72, 73]
    rows = [("a", now - dt.timedelta(hours=h), 100.0 + h, i) for i, h in enumerate(ages)]
    readings_store.write_readings(readings(spark, *rows, ("a", now - dt.timedelta(hours=2), 900.0, 9)), path, 1)
    latest = readings_store.latest_readings(spark, path, now)
    assert [r.glucose_mg_dl for r in latest.collect()] == [124.0, 101.0]
    assert readings_store.latest_readings(spark, path, now, 72).count() == 4
    document = readings_store.latest_documents(latest, 24).first()
    assert (document.hours_requested, document["count"]) == (24, 2)
    assert [r.glucose_mg_dl for r in document.readings] == [124.0, 101.0]
    plan = latest._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    for hours in (0, 169):
        with pytest.raises(ValueError):
            readings_store.latest_readings(spark, path, now, hours)


def test_ingest_csv_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    four = "".join(f"{i},2026/03/06,08:0{i}:00,,{v}\n" for i, v in enumerate([120, 80, 50, 200]))
    write(folder, "one.csv", HEADER + four)
    write(folder, "empty.csv", HEADER)
    write(folder, "nothing.csv", "\n")
    write(folder, "zero.csv", "")
    write(folder, "notes.txt", HEADER + four)
    store = str(tmp_path / "store")
    result = ingest.ingest_csv(spark, str(folder), store, 1)
    assert result.readings_saved == 4
    row = result.results.first()
    assert (row.status, row.readings_saved, row.min_glucose, row.max_glucose) == ("success", 4, 50.0, 200.0)
    assert row.time_in_range_percent == 50.0
    rejected = {os.path.basename(r.source) for r in result.rejected.collect()}
    assert rejected == {"empty.csv", "nothing.csv", "zero.csv"}
    assert [r.readings_saved for r in result.counts.collect()] == [4]
    assert readings_store.read_readings(spark, store).count() == 4
    with ingest.csv_statistics(spark, str(folder)) as report:
        assert report.statistics.count() == 1
        assert {os.path.basename(r.source) for r in report.rejected.collect()} == rejected
    result.close()
    assert not os.path.exists(result.staged)


def test_ingest_json_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.json", '{"sgs":[{"timestamp":1741500000000,"sg":120}]}')
    write(folder, "b.json", '{"sgs":[]}')
    result = ingest.ingest_json(spark, str(folder), str(tmp_path / "store"), "me", 1)
    assert result.readings_saved == 1 and result.results.count() == 1
    assert [os.path.basename(r.source) for r in result.rejected.collect()] == ["b.json"]
    by_file = F.regexp_extract("source", "([a-z])\\.json$", 1)
    with ingest.ingest_json(spark, str(folder), str(tmp_path / "many"), by_file, 1) as many:
        assert many.readings_saved == 1
    assert [r.subject_id for r in readings_store.read_readings(spark, str(tmp_path / "many")).collect()] == ["a"]
