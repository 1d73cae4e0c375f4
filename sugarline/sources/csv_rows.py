"""Rows of CSV text whose quoted cells may hold line breaks.

A line changes whether a quoted cell is open. What it does depends on the state before it, which is
known only once everything before it in the file is; so every line is a function of two states, and
such functions are composed: the lines of a block (a read split, or a fixed number of lines) to one
summary row, and the summary rows of a source in order. Then each block knows in which state it
begins, and only blocks in which some cell stays open at a line's end are worked further: their
lines are put together to rows, also across blocks. All other lines are rows as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = ["source", "block"]
#: A row over this many characters of several lines rejects its source: most likely a quote is
#: never closed, and nothing may gather the rest of a file in one place.
ROW_LIMIT = 1 << 24
#: An odd number of quotes in a row closes a quoted cell; pairs stand for a quote in it.
ODD_QUOTES = '(?<!")"(?:"")*(?!")'


def open_after(line: Column, before: bool) -> Column:
    """Whether a quoted cell is open after the line, given whether one is open before it.

    A quote opens a cell only as its first character.
    """

    def step(is_open: Column, piece: Column) -> Column:
        rest = F.when(is_open, piece).otherwise(F.substr(piece, F.lit(2)))
        return (is_open | F.startswith(piece, F.lit('"'))) & ~rest.rlike(ODD_QUOTES)

    plain = F.lit(before)
    return F.when(line.contains('"'), F.aggregate(F.split(line, ","), plain, step)).otherwise(plain)


def _composed(fixed: Column, swaps: Column, at_fixed: Column, begin: Column) -> Column:
    """State after a run of functions: that of the last one with one result, or the state at the
    beginning, turned round by each swap after it."""
    odd = F.pmod(swaps - F.coalesce(at_fixed, F.lit(0)), F.lit(2)) == 1
    return F.coalesce(fixed, begin) != odd


def _with_functions(rows: DataFrame, from_closed: str, from_open: str, order: str, *keys: str) -> DataFrame:
    """Adds ``_fixed``, ``_at_fixed`` and ``_swaps``: the composition of all functions up to a row."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    closed, opened = F.col(from_closed), F.col(from_open)
    swaps = F.sum(F.when(closed & ~opened, 1).otherwise(0)).over(window)
    rows = rows.withColumn("_swaps", swaps)
    last = F.last(F.when(closed == opened, F.struct(closed.alias("v"), F.col("_swaps").alias("s"))), ignorenulls=True)
    rows = rows.withColumn("_last", last.over(window))
    return rows.withColumns({"_fixed": F.col("_last.v"), "_at_fixed": F.col("_last.s")}).drop("_last")


def _block_states(marked: DataFrame) -> DataFrame:
    """source, block, ``begins_open`` and ``too_long`` of the blocks with a cell that is open at a
    line's end."""
    changes = F.when(
        F.col("_c") | ~F.col("_o"), F.struct("pos", F.col("_c").alias("c"), F.col("_o").alias("o"))
    )

    def through(begin: bool) -> Column:
        return F.aggregate(
            F.col("_changes"), F.lit(begin), lambda s, x: F.when(s, x["o"]).otherwise(x["c"])
        )

    # The text stays in this branch, so that all branches share one shuffle and one scan
    summary = marked.groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(changes)).alias("_changes"),
        F.sum(F.length("line") + 1).alias("_chars"),
    )
    summary = summary.select(
        *BLOCK,
        "_chars",
        (F.size("_changes") == 0).alias("_unchanged"),
        F.exists("_changes", lambda x: x["c"]).alias("_opens"),
        through(False).alias("_from_closed"),
        through(True).alias("_from_open"),
    )
    composed = _with_functions(summary, "_from_closed", "_from_open", "block", "source")
    after = _composed(F.col("_fixed"), F.col("_swaps"), F.col("_at_fixed"), F.lit(False))
    before = F.lag(after, 1, False).over(Window.partitionBy("source").orderBy("block"))
    return (
        composed.select(*BLOCK, "_chars", "_unchanged", "_opens", before.alias("begins_open"))
        # Where nothing is open at first and no line leaves a cell open, every line is a row
        .where(F.col("begins_open") | F.col("_opens"))
        .select(
            *BLOCK,
            "begins_open",
            # The whole block lies inside one cell
            (F.col("_unchanged") & (F.col("_chars") > ROW_LIMIT)).alias("too_long"),
        )
    )


def logical_rows(lines: DataFrame) -> DataFrame:
    """Rows of text, some of several lines: source, block and pos (those of its first line), line
    (its lines with a line feed between them) and ``too_long`` (then without text).

    ``lines`` has source, block, pos and line; blocks of a source and positions in a block ascend.
    A cell that is never closed ends with its source.
    """
    line = F.col("line")
    marked = (
        lines.where(line.isNotNull())
        .select(
            F.coalesce("source", F.lit("")).alias("source"),
            F.coalesce("block", F.lit(0)).alias("block"),
            "pos",
            "line",
            open_after(line, False).alias("_c"),
            open_after(line, True).alias("_o"),
        )
        .repartition(*BLOCK)
    )
    states = _block_states(marked)
    known = marked.join(states, BLOCK, "left")
    plain = known.where(F.col("begins_open").isNull()).select(*BLOCK, "pos", "line", F.lit(False).alias("too_long"))

    inside = _with_functions(known.where("NOT too_long"), "_c", "_o", "pos", *BLOCK)
    in_block = Window.partitionBy(*BLOCK).orderBy("pos")
    after = _composed(F.col("_fixed"), F.col("_swaps"), F.col("_at_fixed"), F.col("begins_open"))
    inside = inside.withColumn("_after", after)
    inside = inside.withColumn("_before", F.coalesce(F.lag("_after").over(in_block), F.col("begins_open")))
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(~F.col("_before"), F.struct(F.col("block").alias("b"), F.col("pos").alias("p")))
    inside = inside.withColumn("_row", F.last(starts, ignorenulls=True).over(so_far))
    single = inside.where("NOT _before AND NOT _after").select(*BLOCK, "pos", "line", F.lit(False).alias("too_long"))

    # Lines before the first row of their block belong to the last row of a block before
    lasts = inside.groupBy(*BLOCK).agg(F.max("_row").alias("_last"))
    blocks = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*BLOCK, F.last("_last", ignorenulls=True).over(blocks).alias("_carried"))
    parts = inside.where("_before OR _after").select("source", "block", "pos", "line", "_row")
    parts = parts.join(carried, BLOCK, "left").withColumn("_row", F.coalesce("_row", "_carried"))
    chars = F.sum(F.length("line") + 1)
    # A line that alone is too long is not gathered
    piece = F.when(F.length("line") <= ROW_LIMIT, F.struct("block", "pos", "line"))
    several = parts.groupBy("source", F.col("_row.b").alias("block"), F.col("_row.p").alias("pos")).agg(
        F.sort_array(F.collect_list(piece)).alias("_parts"), (chars > ROW_LIMIT).alias("too_long")
    )
    text = F.when(~F.col("too_long"), F.array_join("_parts.line", "\n"))
    several = several.select(*BLOCK, "pos", text.alias("line"), "too_long")
    broken = states.where("too_long").select(
        *BLOCK, F.lit(-1).cast(lines.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("line"), "too_long"
    )
    return plain.unionByName(single).unionByName(several).unionByName(broken)
