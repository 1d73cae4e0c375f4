"""What each filter removes, in every order in which the filters can stand.

Only the copies need texts to meet. A counting Bloom filter over text hashes is filled by all tasks
and merged; a text with a cell that nobody else counted is unique for certain and never leaves its
task. What may be a repeat is grouped by its whole text for the least doc_id. Then a document is a
mask of failed filters, masks are counted per source, and every figure of every order is a sum over
at most 32 masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import released, small_batches, stored

FILTERS = "ABCDE"
#: Cells of one row of the merged sketch.
SEGMENT_BITS = 16
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def failed_filters(text: str) -> int:
    """Bits of the filters A to D that a text fails.

    A: under 200 words; B: fewer distinct words than half; C: more than 2 % of the characters are
    A-Z; D: holds one of # $ % & * |.
    """
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * len(text)) << 2
        | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3
    )


def text_hash(text: Column, bits: int = 64) -> Column:
    """64-bit hash of a text (null: empty), of which the low ``bits`` are kept."""
    value = F.xxhash64(F.coalesce(text, F.lit("")))
    return value if bits == 64 else value.bitwiseAND(F.lit((1 << bits) - 1))


def masked(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (among them text) with ``mask``, the filters A to D that a text
    fails, in place of the text."""
    others = [c for c in docs.columns if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [failed_filters(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(masks, pa.int32())], names=[*others, "mask"])

    frame = docs.select(*others, "text")
    return frame.mapInArrow(released(judge), frame.drop("text").withColumn("mask", F.lit(0)).schema)


def cell_bits(n: int, cells: int = 16, most: int = 29) -> int:
    """Bits that name a cell: ``cells`` or more for each of ``n`` texts, 2^``most`` at most."""
    return min(max((cells * n - 1).bit_length(), SEGMENT_BITS), most)


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two cells of each hash, one column each."""
    mixed = hashes.view(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def repeat_bitmap(hashes: DataFrame, bits: int, flush: int = 2_000_000) -> np.ndarray:
    """Bits of the cells that two rows or more of ``hashes`` (h) fall into.

    Each task counts its rows and sends, for every segment of the sketch that it touched, the cells
    with one row and those with more; segments are added up apart from each other. The driver gets
    2^``bits`` bits whatever the data.
    """
    low = (1 << SEGMENT_BITS) - 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            segments = cells >> SEGMENT_BITS
            starts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
            packed = ((cells & low) << 1 | (counts > 1)).astype("<u4")
            parts = [packed[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(segments[starts].astype(np.int32)), pa.array(parts, pa.binary())], names=["segment", "cells"]
            )

        held, amount = [], 0
        for batch in batches:
            held.append(_cells(batch.column(0).to_numpy(), bits).ravel())
            amount += len(held[-1])
            if amount >= flush:
                yield rows(held)
                held, amount = [], 0
        if amount:
            yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(segment: int, counts: np.ndarray) -> pa.RecordBatch:
            bitmap = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict(
                {"segment": pa.array([segment], pa.int32()), "bitmap": pa.array([bitmap], pa.binary())}
            )

        segment, counts = None, np.zeros(0, np.uint8)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != segment:
                    if segment is not None:
                        yield row(segment, counts)
                    segment, counts = name, np.zeros(low + 1, np.uint8)
                packed = np.frombuffer(data, "<u4")
                cells = packed >> 1
                counts[cells] = np.minimum(counts[cells] + (1 + (packed & 1)).astype(np.uint8), 2)
        if segment is not None:
            yield row(segment, counts)

    sent = hashes.select("h").mapInArrow(released(sketch), "segment int, cells binary")
    merged = sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(released(merge), "segment int, bitmap binary")
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    wide = (low + 1) // 8
    for segment, data in merged.toPandas().itertuples(index=False):
        bitmap[segment * wide : (segment + 1) * wide] = np.frombuffer(data, np.uint8)
    return bitmap


def maybe_repeated(frame: DataFrame, bitmap: np.ndarray, bits: int) -> Column:
    """False only for hashes ``h`` that no second row has."""
    shared = frame.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            cells = _cells(hashes.to_numpy(np.int64), bits)
            hit = shared.value[cells >> 3] >> (cells & 7).astype(np.uint8) & 1
            yield pd.Series(hit.all(axis=1))

    return test(F.col("h"))


def document_masks(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, part and mask (all five filters) of each row of ``docs`` (doc_id, source, text).

    Copies are told by their whole texts: a hash stands for a text only where all texts that may
    have it were compared and proved equal; texts that share a hash are joined themselves.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), text_hash(F.col("text"), hash_bits).alias("h"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    flags = stored(masked(rows), "audit-masks")
    bits = cell_bits(flags.count())
    bitmap = repeat_bitmap(flags, bits)
    texts = rows.select("h", "doc_id", "text").where(maybe_repeated(rows, bitmap, bits))
    groups = texts.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    by_hash = groups.groupBy("h").agg(
        F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"), F.sum("rows").alias("rows")
    )
    by_hash = stored(by_hash.where("rows > 1"), "audit-repeats")
    shared = by_hash.where("texts > 1").select("h")
    known = flags.join(by_hash.where("texts = 1").select("h", "least"), "h", "left")
    if not shared.isEmpty():
        collided = rows.join(shared, "h", "left_semi")
        least = collided.groupBy("h", "text").agg(F.min("doc_id").alias("least"))
        apart = masked(collided.join(least, ["h", "text"]))
        known = known.join(shared, "h", "left_anti").unionByName(apart.select(known.columns))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    return known.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            out.append((order, step, bit[name], before))
            before |= bit[name]
    return out


def audit(docs: DataFrame, labels: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row for each part (source; null counts as empty), filter_order and step, with kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``labels`` (doc_id, quality, toxic) may repeat ids; one row that says 1 is enough. Documents
    without doc_id have no label and are no copy of anything, nor do equal ids make a row a copy. A
    null text is empty. Extra columns are ignored; no rows give no result.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counted = (
        document_masks(docs, hash_bits)
        .join(good, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )
    # 32 masks at most for each part
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    listed = F.array(
        *[
            F.struct(
                F.lit(order).alias("filter_order"), F.lit(step).alias("step"),
                F.lit(bit).alias("bit"), F.lit(before).alias("before"),
            )
            for order, step, bit, before in orders()
        ]
    )
    spread = by_part.select("part", "masks", F.inline(listed))

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(masks, 0L, (t, m) -> t + IF({condition}, {value}, 0L))")

    fails, removed = "(m.mask & bit) <> 0", "(m.mask & bit) <> 0 AND (m.mask & before) = 0"
    return spread.select(
        "part",
        "filter_order",
        "step",
        total("m.n", "(m.mask & (bit | before)) = 0").alias("kept"),
        total("m.n", removed).alias("removed"),
        total("m.n", f"{fails} AND (m.mask & before) <> 0").alias("redundant"),
        total("m.n", "m.mask = bit").alias("unique_fails"),
        total("m.good", removed).alias("good_lost"),
        total("m.toxic", removed).alias("toxic_lost"),
        # Of all orders, a share of one by the number of failed filters has this one first among them
        total("m.n * CAST(120 / bit_count(m.mask) AS BIGINT)", fails).alias("shapley"),
    )
