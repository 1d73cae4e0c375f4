"""Documents read in ranges of a few hundred bytes, against an XML parser of whole documents."""

import datetime as dt
import random
import xml.etree.ElementTree as ET

import pytest

from sugarline.sources import xml_events, xml_ranges
from tests.test_sources import XML, write

CHILDREN = {"glucose_level": ("ts", "value"), "bolus": ("ts_begin", "ts", "dose"), "basal": ("ts", "value"), "meal": ("ts", "carbs")}
NAMES = {"glucose_level": "glucose", "bolus": "bolus", "basal": "basal", "meal": "meal"}


def parsed(text):
    """(stream, ts, value) of a document in the order of the document, by stream."""
    out = []
    for parent in ET.fromstring(text).iter():
        if parent.tag in CHILDREN:
            *times, number = CHILDREN[parent.tag]
            for e in parent:
                ts = next((e.get(t) for t in times if e.get(t)), None)
                if ts and e.get(number):
                    try:
                        out.append((NAMES[parent.tag], dt.datetime.strptime(ts, "%d-%m-%Y %H:%M:%S"), float(e.get(number))))
                    except ValueError:
                        continue
    return out


def document(rng, events):
    """Every stream several times, comments with tags, signs in values, elements around and inside."""
    parts = ['<?xml version="1.0"?>\n<!-- export <event ts="01-01-2021 00:00:00" value="1"/> -->\n<patient id="5">']
    at = 0
    while at < events:
        tag = rng.choice([*CHILDREN, "exercise"])
        parts.append(f"<{tag}>" if rng.random() < 0.8 else f"<wrapper note='a > b'>\n<{tag} unit=\"x\">")
        wrapped = "wrapper" in parts[-1]
        for _ in range(rng.randint(0, 30)):
            at += 1
            when = (dt.datetime(2021, 1, 1) + dt.timedelta(minutes=at)).strftime("%d-%m-%Y %H:%M:%S")
            number = {"meal": "carbs", "bolus": "dose"}.get(tag, "value")
            extra = rng.choice(["", ' note="1 > 0 / 2"', " note='say \"ts\" = 1'", ' ts_begin=""', ' type="square"'])
            event = f'<event ts="{when}" {number}="{at}"{extra}'
            event += rng.choice(["/>", "></event>", "><note>5 &gt; 4</note><event ts='x'/></event>"])
            event = rng.choice([event, event, event, f"<!-- {event}\n -->", f"<event><![CDATA[ {event} ]]></event>"])
            parts.append(event + rng.choice(["", "\n", "\n\n  "]))
        parts.append(f"</{tag}>" + "</wrapper>" * wrapped)
    return "".join([*parts, "</patient >\n"])


def stored_events(spark, folder, **kwargs):
    rows = xml_events.read_split(spark, str(folder), "training", **kwargs).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.subject_id, r.stream, r.pos)):
        out.setdefault(r.subject_id, []).append((r.stream, r.ts, r.value))
    return out


@pytest.mark.parametrize("size", ["300", "5000"])
def test_ranges_equal_a_whole_parser(spark, tmp_path, size):
    rng = random.Random(int(size))
    docs = {f"{i}": document(rng, rng.randint(0, 300)) for i in range(4)}
    for name, text in docs.items():
        write(tmp_path, f"{name}-ws-training.xml", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        records = xml_ranges.read_records(spark, str(tmp_path), "*-ws-training.xml")
        assert records.select("source", "block").distinct().count() > 10
        got = stored_events(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in docs.items():
        assert got.get(name, []) == sorted(parsed(text), key=lambda e: e[0]), name


def test_other_documents(spark, tmp_path):
    write(tmp_path, "1-ws-training.xml", "﻿" + XML[XML.index("<patient") :])
    write(tmp_path, "2-ws-training.xml", XML.replace("</patient>", ""))
    write(tmp_path, "3-ws-training.xml", "")
    write(tmp_path, "4-ws-training.xml", '<glucose_level><event ts="01-12-2021 00:01:00" value="9"/></glucose_level>')
    write(tmp_path, "5-ws-training.xml", '<p><meal><event ts="01-12-2021 00:01:00" carbs="&#x35;5&amp;"/></meal></p>')
    got = stored_events(spark, tmp_path)
    assert {k: len(v) for k, v in got.items()} == {"1": 7, "4": 1}


def test_documents_in_parts(spark, tmp_path):
    folder = tmp_path / "file_name=7-ws-training.xml"
    folder.mkdir()
    lines = document(random.Random(9), 200).replace("><", ">\n<").split("\n")
    cuts = [i for i, line in enumerate(lines) if line.startswith("<")][40::40]
    text = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
    for i, part in enumerate(text):
        write(folder, f"part-{i:05d}-x.txt", "\n".join(part) + "\n")
    assert len(text) > 3
    assert stored_events(spark, tmp_path, in_parts=True) == {"7": sorted(parsed("\n".join(lines)), key=lambda e: e[0])}
    assert [r.subject_id for r in xml_events.discover_split_files(spark, str(tmp_path), "training", in_parts=True).collect()] == ["7"]
