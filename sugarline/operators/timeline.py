"""Fixed-cadence timelines: binning, gap filling and look-back features.

Input is one long table of events

    subject_id STRING, stream STRING, ts TIMESTAMP_NTZ, value DOUBLE, pos BIGINT

where ``stream`` is glucose, bolus, basal or meal and ``pos`` is the position in the source.
All streams go through the same aggregates, so aligning them on the grid needs no join.

How the work is spread. A subject may hold any share of the rows, hence no step puts a whole
subject into one task:

* binning is two aggregates with map-side partial results, first per (subject, timestamp), then
  per (subject, bin). What leaves them is at most one row per bin, however many rows came in;
* row windows run per (subject, chunk), a chunk being a fixed number of consecutive bins. That
  number is the size bound of a window group;
* what a chunk needs from its neighbours (the observed bins around it, the last rows and the
  last basal rate before it) is carried by one summary row per chunk. The summaries of a
  subject are ordered in one window; timestamps end at year 9999, so at five minutes there are
  at most about 260,000 of them. They are joined back on (subject, chunk) without a broadcast
  hint: adaptive execution broadcasts them only when they are measured to be small. Every chunk
  has its summary; the joins are left joins all the same, because an inner join adds null
  filters to one branch only and so keeps the branches from sharing their shuffle.

The main data is shuffled three times, smaller each time: by (subject, timestamp), by (subject,
bin), by (subject, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sugarline import constants as C
from sugarline.functions.exact import exact_avg, exact_sum

GLUCOSE, BOLUS, BASAL, MEAL = "glucose", "bolus", "basal", "meal"
# Bins per chunk: two weeks at five minutes
CHUNK_BINS = 4096
CHUNK = ["subject_id", "_chunk"]
# Earlier rows that a look-back needs
KEPT = C.ROLLING_ROWS - 1


def epoch_second(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def bin_number(ts: Column, cadence: int) -> Column:
    """Number of the left-closed bin since the epoch, for times before it too."""
    return F.floor(epoch_second(ts) / cadence)


def bin_start(number: Column, cadence: int) -> Column:
    return F.timestamp_seconds(number * cadence).cast("timestamp_ntz")


def check_cadence(cadence: int) -> int:
    """Bins are counted from the epoch; that equals counting from midnight for divisors of a day."""
    if cadence <= 0 or 86400 % cadence:
        raise ValueError(f"cadence must divide a day, got {cadence} seconds")
    return cadence


# --- binning --------------------------------------------------------------------------------


def filter_series(events: DataFrame, stream: str) -> DataFrame:
    """Events of one stream."""
    return events.where(F.col("stream") == stream)


def sort_by_time(events: DataFrame) -> DataFrame:
    """Events of each subject in time order."""
    return events.orderBy("subject_id", "ts")


def dedup_timestamp(readings: DataFrame, value: str = "value") -> DataFrame:
    """One reading per (subject, timestamp): the first in source order."""
    return readings.groupBy("subject_id", "ts").agg(
        F.min_by(value, "pos").alias(value), F.min("pos").alias("pos")
    )


def merge_streams(events: DataFrame) -> DataFrame:
    """One row per (subject, timestamp) with a column per stream.

    Glucose keeps the first reading of a timestamp, doses and carbohydrates add up, the basal
    rate keeps the last one.
    """

    def of(stream: str, column: str) -> str:
        return f"IF(stream = '{stream}', {column}, NULL)"

    return (
        events.where("subject_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")
        .groupBy("subject_id", "ts")
        .agg(
            F.expr(f"min_by({of(GLUCOSE, 'value')}, {of(GLUCOSE, 'pos')}) AS glucose"),
            exact_sum(of(BOLUS, "value")).alias("bolus"),
            F.expr(f"max_by({of(BASAL, 'value')}, {of(BASAL, 'pos')}) AS basal"),
            exact_sum(of(MEAL, "value")).alias("carbs"),
        )
    )


def resample(
    events: DataFrame, cadence: int = C.CADENCE_SECONDS, chunk_bins: int = CHUNK_BINS
) -> DataFrame:
    """One row per (subject, bin) that holds any event.

    Mean glucose, summed doses and carbohydrates, last basal rate; NULL where the stream has
    nothing in the bin. ``_chunk`` numbers the chunk of the bin.
    """
    check_cadence(cadence)
    return (
        merge_streams(events)
        .withColumn("bin", bin_number(F.col("ts"), cadence))
        .withColumn("_chunk", F.expr(f"(bin - pmod(bin, {chunk_bins})) div {chunk_bins}"))
        .groupBy(*CHUNK, "bin")
        .agg(
            exact_avg("glucose").alias("glucose"),
            exact_sum("bolus").alias("bolus"),
            F.expr("max_by(basal, IF(basal IS NULL, NULL, ts)) AS basal"),
            exact_sum("carbs").alias("carbs"),
        )
    )


# --- gap filling ----------------------------------------------------------------------------


ACROSS_CHUNKS = "OVER (PARTITION BY subject_id ORDER BY _chunk)"
IN_CHUNK = "OVER (PARTITION BY subject_id, _chunk ORDER BY bin)"
IN_CHUNK_SO_FAR = (
    "OVER (PARTITION BY subject_id, _chunk ORDER BY bin"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)


def locate_bins(bins: DataFrame, limit: int = C.FILL_LIMIT) -> DataFrame:
    """Occupied bins that lie on the glucose grid, with the observed bins around them.

    The grid holds the observed bins and the first ``limit`` bins of every gap; nothing lies
    before the first or after the last observation. ``last`` is the last grid bin before the
    next occupied one: the row stands for the grid bins from ``bin`` to ``last``. ``prev`` and
    ``next`` are the observed bins the glucose of those is drawn between (``prev`` is the bin
    itself where it is observed).
    """
    occupied = bins.repartition(*CHUNK).selectExpr(
        "*", "IF(glucose IS NULL, NULL, bin) AS observed"
    )

    summary = occupied.groupBy(*CHUNK).agg(
        F.expr("min(bin) AS first_bin"),
        F.expr("min(observed) AS first_observed"),
        F.expr("min_by(glucose, observed) AS first_glucose"),
        F.expr("max(observed) AS last_observed"),
        F.expr("max_by(glucose, observed) AS last_glucose"),
        # Every bin counts here. The count keeps all columns alive in this branch, so that both
        # branches read one shuffle of the same columns instead of each making its own.
        F.expr("count(coalesce(glucose, bolus, basal, carbs)) AS bins"),
    )
    around = summary.where("bins > 0").selectExpr(
        *CHUNK,
        f"lag(last_observed) IGNORE NULLS {ACROSS_CHUNKS} AS before_bin",
        f"lag(last_glucose) IGNORE NULLS {ACROSS_CHUNKS} AS before_glucose",
        f"lead(first_observed) IGNORE NULLS {ACROSS_CHUNKS} AS after_bin",
        f"lead(first_glucose) IGNORE NULLS {ACROSS_CHUNKS} AS after_glucose",
        f"lead(first_bin) {ACROSS_CHUNKS} AS after_any",
    )

    inside = occupied.selectExpr(
        *CHUNK,
        "bin",
        "bolus",
        "basal",
        "carbs",
        f"last(observed, true) {IN_CHUNK_SO_FAR} AS in_prev",
        f"last(glucose, true) {IN_CHUNK_SO_FAR} AS in_prev_glucose",
        f"lead(observed) IGNORE NULLS {IN_CHUNK} AS in_next",
        f"lead(glucose) IGNORE NULLS {IN_CHUNK} AS in_next_glucose",
        f"lead(bin) {IN_CHUNK} AS in_any",
        f"lead(observed, {KEPT}) IGNORE NULLS {IN_CHUNK} IS NULL AS near_end",
    )
    located = inside.join(around, CHUNK, "left").selectExpr(
        *CHUNK,
        "bin",
        "bolus",
        "basal",
        "carbs",
        "near_end",
        "coalesce(in_prev, before_bin) AS prev",
        "coalesce(in_prev_glucose, before_glucose) AS prev_glucose",
        "coalesce(in_next, after_bin) AS next",
        "coalesce(in_next_glucose, after_glucose) AS next_glucose",
        "coalesce(in_any, after_any) AS next_any",
    )
    last = f"CASE WHEN next IS NOT NULL THEN least(next_any - 1, prev + {limit})"
    last += " WHEN bin = prev THEN bin END"
    return located.selectExpr("*", f"{last} AS last").where("prev IS NOT NULL AND last >= bin")


def _grid_values(grid_bin: str, row: str = "") -> dict[str, str]:
    """Values of a grid bin: glucose on the line between the observed bins around it; doses,
    carbohydrates and basal rates on their own bin only. ``row`` prefixes the located row."""
    slope = f"({row}next_glucose - {row}prev_glucose) / ({row}next - {row}prev)"
    return {
        "glucose": f"IF({grid_bin} = {row}prev, {row}prev_glucose,"
        f" {slope} * ({grid_bin} - {row}prev) + {row}prev_glucose)",
        "bolus": f"coalesce(IF({grid_bin} = {row}bin, {row}bolus, NULL), 0D)",
        "basal": f"IF({grid_bin} = {row}bin, {row}basal, NULL)",
        "carbs": f"coalesce(IF({grid_bin} = {row}bin, {row}carbs, NULL), 0D)",
    }


def expand_grid(located: DataFrame) -> DataFrame:
    """One row per grid bin."""
    grid = located.selectExpr("*", "explode(sequence(bin, last)) AS grid_bin")
    values = [f"{sql} AS {name}" for name, sql in _grid_values("grid_bin").items()]
    return grid.selectExpr(*CHUNK, "grid_bin", "grid_bin > prev AS filled", *values)


def fill_grid(bins: DataFrame, limit: int = C.FILL_LIMIT) -> DataFrame:
    """The glucose grid: observed bins and the first ``limit`` interpolated bins of every gap.

    Values of the other streams are lost where the grid has no such bin.
    """
    return expand_grid(locate_bins(bins, limit))


# --- look-back features ---------------------------------------------------------------------


def look_back(located: DataFrame) -> DataFrame:
    """Deltas, rolling sums and the carried basal rate, by grid row and not by clock.

    Rows on both sides of a dropped gap are neighbours. The first rows of a chunk take what
    they miss from the last rows of the chunks before it.
    """
    values = _grid_values("g", "r.")
    row = ", ".join(f"{values[name]} AS {name}" for name in ("glucose", "bolus", "carbs"))
    tail = f"flatten(transform(rows, r -> transform(sequence(r.bin, r.last), g -> struct({row}))))"
    fields = "bin, last, prev, next, prev_glucose, next_glucose, bolus, carbs"
    tails = (
        located.groupBy(*CHUNK)
        .agg(
            # The last KEPT + 1 observed bins at most, and 3 other located bins after each
            F.expr(f"array_sort(collect_list(IF(near_end, struct({fields}), NULL))) AS rows"),
            F.expr("max_by(basal, IF(basal IS NULL, NULL, bin)) AS basal"),
        )
        .selectExpr(*CHUNK, f"{tail} AS tail", "basal")
        .selectExpr(*CHUNK, f"slice(tail, greatest(size(tail) - {KEPT - 1}, 1), {KEPT}) AS tail", "basal")
    )
    # A chunk has at least one row, so KEPT chunks hold enough of them
    earlier = f"{ACROSS_CHUNKS[:-1]} ROWS BETWEEN {KEPT} PRECEDING AND 1 PRECEDING)"
    carried = tails.selectExpr(
        *CHUNK,
        f"flatten(collect_list(tail) {earlier}) AS tail",
        f"lag(basal) IGNORE NULLS {ACROSS_CHUNKS} AS before_basal",
    )

    over = "OVER (PARTITION BY subject_id, _chunk ORDER BY grid_bin"
    rolling = f"{over} ROWS BETWEEN {KEPT} PRECEDING AND CURRENT ROW)"
    inside = expand_grid(located).selectExpr(
        *CHUNK,
        "grid_bin",
        "glucose",
        f"row_number() {over}) AS row",
        f"lag(glucose, 1) {over}) AS lag_1",
        f"lag(glucose, 3) {over}) AS lag_3",
        f"sum(bolus) {rolling} AS bolus",
        f"sum(carbs) {rolling} AS carbs",
        f"last(basal, true) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS basal",
    )
    full = inside.join(carried, CHUNK, "left").selectExpr(
        "*", f"greatest(least({C.ROLLING_ROWS} - row, size(tail)), 0) AS missing"
    )

    def delta(n: int) -> str:
        before = f"try_element_at(tail, IF(row <= {n}, row - {n + 1}, NULL)).glucose"
        return f"glucose - coalesce(lag_{n}, {before}) AS glucose_delta_{n}"

    def rolled(name: str) -> str:
        before = "slice(tail, size(tail) - missing + 1, missing)"
        total = f"aggregate({before}, 0D, (total, r) -> total + r.{name}) + {name}"
        return f"IF(missing > 0, {total}, {name})"

    return full.selectExpr(
        "subject_id",
        "grid_bin",
        "glucose",
        delta(1),
        delta(3),
        f"{rolled('bolus')} AS bolus_last_1h",
        "coalesce(basal, before_basal, 0D) AS basal_rate",
        f"{rolled('carbs')} AS carbs_last_1h",
    )
