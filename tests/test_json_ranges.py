"""Documents read in ranges of a few hundred bytes, against a JSON parser of whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sugarline.sources import json_docs, json_ranges
from tests.test_sources import write

T0 = 1741500000000


def value(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 2 else 3)
    if kind == 4:
        return {rng.choice(["sgs", "a", 'q"}{[', "timestamp"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return [rng.randint(0, 99), None, rng.choice(['a}{"sgs":[{', "\\", '\\"', "x]", "é}", ""]), True][kind]


def document(rng, entries):
    """Entries with nested members and odd texts, others that are no objects, and arrays around."""
    sgs = []
    for i in range(entries):
        entry = {"timestamp": T0 + i * 1000, "sg": 40 + i % 300}
        for k in range(rng.choice([0, 0, 1, 2])):
            entry[f"m{k}"] = value(rng)
        sgs.append(dict(sorted(entry.items(), key=lambda _: rng.random())))
        if rng.random() < 0.2:
            sgs.append(rng.choice([7, None, "}", [{"timestamp": T0, "sg": 999}], {"sg": 5}, {"timestamp": T0, "sg": 0}]))
    root = {"before": value(rng), "markers": [{"timestamp": T0, "sg": 888}], "sgs": sgs, "after": [{"timestamp": T0, "sg": 777}]}
    items = list(root.items())
    rng.shuffle(items)
    return dict(items)


def usable(doc):
    return [e["sg"] for e in doc["sgs"] if isinstance(e, dict) and e.get("timestamp") and e.get("sg")]


@pytest.mark.parametrize("size", ["250", "3000"])
def test_ranges_equal_a_whole_parser(spark, tmp_path, size):
    rng = random.Random(int(size))
    docs = {}
    for i in range(6):
        docs[f"d{i}"] = document(rng, rng.randint(0, 120))
        text = json.dumps(docs[f"d{i}"], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        write(tmp_path, f"d{i}.json", text + rng.choice(["", "\n", " "]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert json_ranges.read_records(spark, str(tmp_path)).select("source", "block").distinct().count() > 10
        rows = json_docs.read_cgm_json(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: r.pos):
        got.setdefault(r.source.split("/")[-1][:-5], []).append(r.glucose_mg_dl)
    assert got == {k: v for k, v in ((k, usable(d)) for k, d in docs.items()) if v}


def test_documents_in_parts(spark, tmp_path):
    folder = tmp_path / "file_name=me.json"
    folder.mkdir()
    lines = ['{"sgs":[', *[("," if i else "") + f'{{"timestamp":{T0 + i * 1000},"sg":{50 + i}}}' for i in range(90)], "]}"]
    for i in range(0, len(lines), 20):
        write(folder, f"part-{i // 20:05d}-x.txt", "\n".join(lines[i : i + 20]) + "\n")
    rows = json_docs.read_cgm_json(spark, str(tmp_path), in_parts=True).orderBy("pos").collect()
    assert [r.glucose_mg_dl for r in rows] == [50.0 + i for i in range(90)] and {r.source for r in rows} == {"me.json"}


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    lines = spark.range(200_000).select(
        F.concat(F.when(F.col("id") > 0, ",").otherwise('{"sgs":['), F.format_string('{"timestamp":%d,"sg":120}', F.col("id") * 1000 + T0))
    )
    text = "\n".join(r[0] for r in lines.collect()) + "]}"
    write(tmp_path, "big.json", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        assert json_ranges.read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        assert json_docs.read_cgm_json(spark, str(tmp_path)).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
