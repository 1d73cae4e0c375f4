"""Rows over several lines, against Python's csv reader."""

import csv
import io
import random

import pytest

from sugarline import constants as C
from sugarline.plans import ingest
from sugarline.sources import csv_export, csv_rows
from tests.test_sources import HEADER, ROWS, csv_values, write


def reader_rows(lines):
    return list(csv.reader(io.StringIO("".join(line + "\n" for line in lines), newline="")))


def random_sources(rng, n):
    """Lines of sources dealt over blocks, with quotes in every place."""
    rows, sources = [], {}
    for s in range(n):
        text = "".join(rng.choices(['"', '"', ",", "\n", "a", "b ", '""', '"x"', '""'], k=rng.randint(0, 70)))
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        block = 0
        for i, line in enumerate(lines):
            rows.append((f"s{s}", block, i, line))
            if rng.random() < 0.4:
                block += rng.randint(1, 3)
        sources[f"s{s}"] = lines
    return rows, sources


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_equal_those_of_a_csv_reader(spark, seed):
    rows, sources = random_sources(random.Random(seed), 80)
    lines = spark.createDataFrame(rows, "source string, block bigint, pos bigint, line string").repartition(7)
    got = {}
    for r in sorted(csv_rows.logical_rows(lines).collect(), key=lambda r: (r.source, r.block, r.pos)):
        got.setdefault(r.source, []).append(next(iter(reader_rows([r.line])), []))
    for source, text in sources.items():
        want = reader_rows(text)
        found = got.get(source, [])
        assert found[:-1] == want[:-1] and len(found) == len(want), text
        if want:
            assert [c.rstrip("\n") for c in found[-1]] == [c.rstrip("\n") for c in want[-1]], text


def test_line_breaks_in_cells(spark, tmp_path):
    text = '0,2026/03/06,07:55:00,"a\r\nb",117\n1,2026/03/06,08:00:00,"say ""x""\n\n,",118\n'
    write(tmp_path, "p1.csv", HEADER + text + ROWS)
    assert [v for _, v in csv_values(spark, tmp_path)] == [117.0, 118.0, 120.0, 118.0, 115.0]


def test_a_header_inside_a_cell_is_none_and_one_with_a_broken_cell_is(spark, tmp_path):
    write(tmp_path, "p1.csv", HEADER + f'0,2026/03/06,07:55:00,"x\n{HEADER}y",117\n' + ROWS)
    write(tmp_path, "p2.csv", '"Note\n1",Sensor Glucose (mg/dL),Date,"Time"\nn,99,2026/03/06,08:00:00\n')
    assert [v for _, v in csv_values(spark, tmp_path)] == [117.0, 120.0, 118.0, 115.0, 99.0]


def test_cells_over_read_splits(spark, tmp_path):
    """Cells of a few hundred characters begin and end in different pieces of the file."""
    rng = random.Random(4)
    body = ""
    values = []
    for i in range(400):
        note = "\n".join("n" * rng.randint(0, 30) + '""' * rng.randint(0, 2) for _ in range(rng.randint(1, 40)))
        body += f'{i},2026/03/{1 + i // 1440:02d},{i // 60 % 24:02d}:{i % 60:02d}:00,"{note}",{100 + i % 50}\n'
        values.append(100.0 + i % 50)
    write(tmp_path, "p1.csv", HEADER + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert csv_export.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 100
        assert [v for _, v in csv_values(spark, tmp_path)] == values
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    """The rest of the file is one cell; beyond the limits the file is rejected, others are not."""
    write(tmp_path, "p1.csv", HEADER + ROWS + '3,2026/03/06,08:20:00,"open,100\n' + ROWS)
    assert [v for _, v in csv_values(spark, tmp_path)] == [120.0, 118.0, 115.0]
    write(tmp_path, "p1.csv", HEADER + ROWS + '3,2026/03/06,08:20:00,"open,100\n' + ROWS * 3000)
    write(tmp_path, "p2.csv", HEADER + ROWS)
    for limit in (csv_rows.ROW_LIMIT, 2000):
        monkeypatch.setattr(csv_rows, "ROW_LIMIT", limit)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        try:
            with ingest.csv_statistics(spark, str(tmp_path)) as report:
                assert [(r.source.split("/")[-1], r.reason) for r in report.rejected.collect()] == [("p1.csv", C.CSV_TOO_LONG)]
                assert [r["count"] for r in report.statistics.collect()] == [3]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tallies_by_first_failing_rule(spark, tmp_path):
    bad = "1,INVALID,INVALID,,not_a_number\n1,2026/03/06,08:05:00,,  \n1,2026/03/06\n\n"
    write(tmp_path, "a.csv", "x\n" + HEADER + bad + ROWS)
    write(tmp_path, "b.csv", HEADER.replace("Date", "Day") + ROWS)
    with ingest.ingest_csv(spark, str(tmp_path), str(tmp_path / "store"), 1) as result:
        rows = {r.source.split("/")[-1]: r for r in result.tallies.collect()}
        assert {r.source.split("/")[-1]: r.reason for r in result.rejected.collect()} == {"b.csv": C.CSV_BROKEN_HEADER}
    a, b = rows["a.csv"], rows["b.csv"]
    assert (a.readings, a.headers, a.above_header, a.short_or_blank, a.unparsable, a.of_rejected_source) == (3, 1, 1, 3, 1, 0)
    assert (b.readings, b.of_rejected_source, b.source_error) == (0, 4, C.CSV_BROKEN_HEADER)
