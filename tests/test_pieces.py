"""Documents in pieces: many in few files, one in many pieces, with the results of separate files."""

import os

from pyspark.sql import functions as F

from sugarline.plans import ingest
from sugarline.registry import fixtures
from sugarline.sources import csv_export, json_docs, pieces, xml_events
from tests.test_sources import HEADER

T0 = 1741500000000


def stored(spark, path, documents, empty=()):
    rows = [(name, i, line) for name, lines in documents.items() for i, line in enumerate(lines)]
    pieces.write_pieces(spark.createDataFrame(rows, "file_name string, pos bigint, line string"), str(path), empty)
    return str(path)


def test_files_follow_the_bytes_not_the_documents(spark, tmp_path):
    for subjects, folder in ((40, tmp_path / "few"), (400, tmp_path / "many")):
        folder.mkdir()
        ts = F.timestamp_micros(F.lit(1704200000000000) + F.col("id") * 3600000000).cast("timestamp_ntz")
        spark.range(800).select(
            F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % subjects).alias("user_id"),
            F.lit("click").alias("event_type"), F.lit(120.5).alias("value"),
        ).write.parquet(f"{folder}/events.parquet")
        for files, documents in (
            (fixtures.csv_files, subjects + 4), (fixtures.json_files, subjects + 1), (fixtures.xml_files, None),
        ):
            path = files(spark, str(folder))
            found = sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)
            assert 0 < found <= 10
            assert documents is None or pieces.read_names(spark, path).count() == documents


def test_exports(spark, tmp_path):
    rows = [f"{i},2026/03/{1 + i // 1440:02d},{i // 60 % 24:02d}:{i % 60:02d}:00,\"a\nb\",{100 + i % 50}" for i in range(2500)]
    body = [part for row in rows for part in row.split("\n")]
    documents = {"a.csv": ["preamble", HEADER.strip(), *body], "b.csv": [HEADER.strip()], "c.csv": [None], "d.txt": rows[:1]}
    folder = stored(spark, tmp_path / "in", documents, ["e.csv"])
    assert pieces.read_pieces(spark, folder).where("file_name = 'a.csv'").count() >= 5
    got = csv_export.parse_lines(csv_export.read_piece_lines(spark, folder)).orderBy("source", "pos").collect()
    assert [(r.source, r.glucose_mg_dl) for r in got] == [("a.csv", 100.0 + i % 50) for i in range(2500)]
    with ingest.csv_statistics(spark, folder, in_pieces=True) as report:
        assert sorted(r.source for r in report.rejected.collect()) == ["b.csv", "c.csv", "e.csv"]
        assert {r.source: r.short_or_blank + r.above_header for r in report.tallies.collect()}["c.csv"] == 1


def test_json_documents(spark, tmp_path):
    entry = '%s{"timestamp":%d,"sg":%d,"note":"\\"}{["}'
    entries = [entry % ("," if i else "", T0 + i * 1000, 40 + i % 300) for i in range(3000)]
    documents = {"a.json": ['{"x":["}"],"sgs":[', *entries, "]}"], "b.json": ['{"sgs":[' + entries[0], "]}", " "], "c.json": entries}
    folder = stored(spark, tmp_path / "in", documents, ["d.json"])
    got = json_docs.read_cgm_json(spark, folder, in_pieces=True).orderBy("source", "pos").collect()
    assert [(r.source, r.glucose_mg_dl) for r in got] == [("a.json", 40.0 + i % 300) for i in range(3000)] + [("b.json", 40.0)]
    names = json_docs.read_sources(spark, folder, in_pieces=True).collect()
    assert sorted(r.source for r in names) == ["a.json", "b.json", "c.json", "d.json"]


def test_event_documents(spark, tmp_path):
    event = '<event ts="01-12-2021 %02d:%02d:%02d" value="%d"/>'
    events = [event % (i // 3600, i // 60 % 60, i % 60, i) for i in range(3000)]
    text = ["<!-- <x> -->", "<patient><glucose_level>", *events, "</glucose_level>", "</patient>"]
    folder = stored(spark, tmp_path / "in", {"7-ws-training.xml": text, "8-ws-testing.xml": text[1:4] + text[-2:], "9-ws-training.xml": text[:9]})
    got = xml_events.read_split(spark, folder, "training", in_pieces=True).orderBy("pos").collect()
    assert [(r.subject_id, r.value) for r in got] == [("7", float(i)) for i in range(3000)]
    found = xml_events.discover_split_files(spark, folder, "training", in_pieces=True).collect()
    assert [(r.file_name, r.subject_id) for r in found] == [("7-ws-training.xml", "7"), ("9-ws-training.xml", "9")]
