"""Vendor CSV exports: free preamble, header rows anywhere and repeated, data rows below.

The text is read line by line, so a file of any size is split over many tasks. Lines become rows as
``csv_rows`` says: quoted cells may hold commas, doubled quotes and line breaks. A row finds its
header by a window over its block of the file (a read split, or a fixed number of lines), and
from the blocks before it through one summary row per block.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sugarline import constants as C
from sugarline.functions import parsing
from sugarline.functions.once import once
from sugarline.session import list_files, list_folders
from sugarline.sources import pieces
from sugarline.sources.csv_rows import BLOCK, logical_rows

LINES_PER_BLOCK = 100_000
# A comma, then a quoted cell with whatever follows its closing quote (or none), or a plain cell
CELL = r',("[^"]*(?:""[^"]*)*(?:"[^,]*|\z)|[^,]*)'
QUOTED = r'(?s)^"([^"]*(?:""[^"]*)*)(?:"(.*))?\z'

#: What becomes of a row, by the first rule that it fails.
READING, HEADER, ABOVE_HEADER, BLANK, UNPARSABLE, REJECTED = (
    "reading", "header", "above_header", "short_or_blank", "unparsable", "rejected_source",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``*.csv`` files below the folder: source, block, pos, line."""
    return (
        spark.read.option("pathGlobFilter", "*.csv")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").alias("line"),
        )
    )


def read_part_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exports that a job wrote in parts: ``file_name=<name>/part-<number>...`` below the
    folder, in the order of the numbers. The source is the name."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return (
        spark.read.schema("value string, file_name string")
        .text(path)
        .select(
            F.col("file_name").alias("source"),
            # A part has less than 2^36 bytes
            (F.shiftleft(part, 36) + F.col("_metadata.file_block_start")).alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").alias("line"),
        )
    )


def read_piece_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exports that are kept in pieces (see ``pieces``). The source is the name."""
    text = F.regexp_replace("text", "^\ufeff|(?:\r\n|\r|\n)\\z", "")
    lines = pieces.read_pieces(spark, path).where("text != ''")
    return lines.select(
        F.col("file_name").alias("source"),
        pieces.block().alias("block"),
        F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "line"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def read_piece_sources(spark: SparkSession, path: str) -> DataFrame:
    """Names of all ``*.csv`` exports in pieces, those of zero bytes too."""
    return csv_only(pieces.read_names(spark, path).withColumnRenamed("file_name", "source"))


def read_part_sources(spark: SparkSession, path: str) -> DataFrame:
    """Names of all ``*.csv`` exports in parts, those of zero bytes too."""
    names = [(unquote(f.split("file_name=", 1)[1]),) for f in list_folders(spark, path) if "file_name=" in f]
    return csv_only(spark.createDataFrame(names, "source string"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Paths of all ``*.csv`` files, without reading them.

    Spark passes over files of zero bytes, so those are added from the folder's listing.
    """
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(path)
        .select(F.col("_metadata.file_path").alias("source"))
    )
    empty = [(_as_url(p),) for p, size, _ in list_files(spark, path) if size == 0]
    return found.union(csv_only(spark.createDataFrame(empty, "source string")))


def csv_only(names: DataFrame, column: str = "source") -> DataFrame:
    return names.where(F.col(column).endswith(".csv"))


def _as_url(path: str) -> str:
    """A path as scans give it."""
    return re.sub("^file:/(?!/)", "file:///", path)


def document_lines(documents: DataFrame) -> DataFrame:
    """Lines of documents held as (source, text) rows."""
    text = F.regexp_replace("text", "^\ufeff", "")
    lines = documents.select("source", F.posexplode(F.split(text, "\r\n|\r|\n")))
    return lines.select(
        "source",
        (F.floor(F.col("pos") / LINES_PER_BLOCK) * LINES_PER_BLOCK).alias("block"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("col").alias("line"),
    )


def file_stem(source: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")


def split_cells(line: Column) -> Column:
    def unquote(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, QUOTED, 1), F.lit('""'), F.lit('"'))
        return F.when(
            F.startswith(cell, F.lit('"')), F.concat(inner, F.regexp_extract(cell, QUOTED, 2))
        ).otherwise(cell)

    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    return F.when(line.contains('"'), F.transform(quoted, unquote)).otherwise(F.split(line, ","))


def carry_header(lines: DataFrame) -> DataFrame:
    """Each row with the cell positions its header gives (NULL above the first header).

    Adds ``is_header``, ``h_glucose``, ``h_date``, ``h_time`` (0 where the header lacks the
    cell), ``row`` (increasing through the source) and ``source_error``: why the whole source
    cannot be read (some header lacks date or time, a cell or row is too long), or NULL.
    """
    cells = split_cells(F.col("line"))
    names = {
        "h_glucose": C.CSV_GLUCOSE_HEADER,
        "h_date": C.CSV_DATE_HEADER,
        "h_time": C.CSV_TIME_HEADER,
    }
    has_name = F.col("line").contains(C.CSV_GLUCOSE_HEADER)
    is_header = has_name & F.array_contains(cells, C.CSV_GLUCOSE_HEADER)
    own = {
        f"own_{h}": F.when(is_header, F.array_position(cells, name)) for h, name in names.items()
    }
    long_cell = F.exists(cells, lambda cell: F.length(cell) > C.CSV_CELL_LIMIT)
    too_long = F.col("too_long") | ((F.length("line") > C.CSV_CELL_LIMIT) & long_cell)
    marked = logical_rows(lines).withColumns(own | {"too_long": too_long})

    is_own = F.col("own_h_glucose").isNotNull()
    broken = (F.col("own_h_date") == 0) | (F.col("own_h_time") == 0)
    summary = marked.groupBy(*BLOCK).agg(
        # Counting the lines keeps the text column in this branch, so that both branches share
        # one shuffle and the input is read once
        F.count("line").alias("_lines"),
        *[
            F.max_by(f"own_{h}", F.when(is_own, F.col("pos"))).alias(f"_last_{h}") for h in names
        ],
        F.max(
            F.when(F.col("too_long"), C.CSV_TOO_LONG).when(broken, C.CSV_BROKEN_HEADER)
        ).alias("_error"),
    )
    blocks = Window.partitionBy("source")
    carried = summary.where((F.col("_lines") > 0) | F.col("_error").isNotNull()).select(
        *BLOCK,
        *[
            F.expr(
                f"lag(_last_{h}) IGNORE NULLS OVER (PARTITION BY source ORDER BY block)"
            ).alias(f"_before_{h}")
            for h in names
        ],
        F.max("_error").over(blocks).alias("source_error"),
    )

    in_block = Window.partitionBy(*BLOCK).orderBy("pos")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.select(
        *BLOCK,
        "line",
        is_own.alias("is_header"),
        # Row number in the block plus the block's own start: no row is shorter than a byte
        (F.col("block") + F.row_number().over(in_block)).alias("row"),
        *[F.last(f"own_{h}", ignorenulls=True).over(so_far).alias(f"_in_{h}") for h in names],
    )
    return inside.join(carried, BLOCK, "left").select(
        *BLOCK,
        "row",
        "line",
        "is_header",
        *[F.coalesce(f"_in_{h}", f"_before_{h}").alias(h) for h in names],
        "source_error",
    )


def _is_data() -> Column:
    return (
        F.col("h_glucose").isNotNull() & ~F.col("is_header") & F.col("source_error").isNull()
    )


def drop_before_header(located: DataFrame) -> DataFrame:
    """Data rows: below a header, not a header, and not of a source that cannot be read."""
    return located.where(_is_data())


def _with_cells(rows: DataFrame, *kept: Column) -> DataFrame:
    """The glucose, date and time cells of each row, null where the row does not reach them."""

    def cell(cells: Column, name: str) -> Column:
        return F.try_element_at(cells, F.nullif(F.col(name), F.lit(0)).cast("int"))

    def three(cells: Column) -> Column:
        return F.struct(
            cell(cells, "h_glucose").alias("glucose_cell"),
            cell(cells, "h_date").alias("date_cell"),
            cell(cells, "h_time").alias("time_cell"),
        )

    # The lambda binds the cells, so that a row is split once
    cells = F.when(_is_data(), split_cells(F.col("line")))
    return rows.select("source", "row", *kept, F.inline(F.transform(F.array(cells), three)))


def _has_value() -> Column:
    return parsing.strip(F.col("glucose_cell")) != ""


def drop_short_or_blank(data: DataFrame) -> DataFrame:
    """Cells of the rows that reach the glucose column and hold something there."""
    return _with_cells(data).where(_has_value())


def _with_values(cells: DataFrame, *kept: Column) -> DataFrame:
    return cells.select(
        "source",
        F.col("row").alias("pos"),
        *kept,
        once(
            ts=parsing.parse_csv_ts(F.col("date_cell"), F.col("time_cell")),
            glucose_mg_dl=parsing.decode_sentinel(F.col("glucose_cell")),
        ),
    )


def _is_parsed() -> Column:
    return F.col("ts").isNotNull() & F.col("glucose_mg_dl").isNotNull()


def drop_unparsable(cells: DataFrame) -> DataFrame:
    return _with_values(cells).where(_is_parsed())


def row_outcomes(lines: DataFrame) -> DataFrame:
    """Every row of every source, parsed once: source, pos, outcome, source_error, and ts,
    glucose_mg_dl and units of the readings. ``outcome`` names the first rule that a row fails."""
    located = carry_header(lines)
    place = (
        F.when(F.col("source_error").isNotNull(), REJECTED)
        .when(F.col("is_header"), HEADER)
        .when(F.col("h_glucose").isNull(), ABOVE_HEADER)
    )
    cells = _with_cells(located, place.alias("place"), F.col("source_error"))
    outcome = F.coalesce(F.col("place"), F.when(F.coalesce(_has_value(), F.lit(False)), READING).otherwise(BLANK))
    values = _with_values(cells, outcome.alias("outcome"), F.col("source_error"))
    found = (F.col("outcome") == READING) & _is_parsed()
    return values.select(
        "source",
        "pos",
        F.when((F.col("outcome") == READING) & ~_is_parsed(), UNPARSABLE).otherwise(F.col("outcome")).alias("outcome"),
        "source_error",
        *[F.when(found, F.col(c)).alias(c) for c in ("ts", "glucose_mg_dl")],
        F.when(found, C.UNITS).alias("units"),
    )


def tally(outcomes: DataFrame) -> DataFrame:
    """Number of rows of each outcome per source, and why the source is rejected, if it is.

    Sums are made by the tasks first; a source of any size is one row here.
    """
    counts = {
        "readings": READING, "headers": HEADER, "above_header": ABOVE_HEADER, "short_or_blank": BLANK,
        "unparsable": UNPARSABLE, "of_rejected_source": REJECTED,
    }
    return outcomes.groupBy("source").agg(
        *[F.count_if(F.col("outcome") == name).alias(column) for column, name in counts.items()],
        F.max("source_error").alias("source_error"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Readings: source, pos, ts, glucose_mg_dl, units."""
    data = drop_before_header(carry_header(lines))
    return drop_unparsable(drop_short_or_blank(data)).withColumn("units", F.lit(C.UNITS))


def read_cgm_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings of all CSV exports in a folder; the subject is the file's stem."""
    readings = parse_lines(read_lines(spark, path))
    return readings.withColumn("subject_id", file_stem(F.col("source")))
