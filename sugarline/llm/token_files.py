"""Token ids of documents in compressed files, and back.

A set of files is a Parquet folder of blocks and a small one with the shared frequency table. The
documents' ids stand one after the other in ascending doc_id; each part holds a range of them, cut
into blocks of a fixed number of ids. A block is coded by itself with the shared table (see
``rans``) and names the documents that its ids belong to, so blocks are read by any task in any
order, and a block from its checkpoints.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sugarline.llm import rans
from sugarline.llm.bpe_ids import byte_bpe, default_tokenizer
from sugarline.llm.common import released, small_batches, stored, text_blocks
from sugarline.session import scratch_dir

#: Ids of a block.
BLOCK = 1 << 18
#: A row of the files. ``first`` is the place of the block's first id in its part; ``ordinal``
#: counts the part's documents up to the block's first; ``begun`` are the ids of that document that
#: stand in blocks before; ``open`` tells that the last document goes on in the next block.
SCHEMA = (
    "part int, block int, first bigint, ordinal bigint, begun bigint, open boolean, doc_ids array<bigint>, "
    "lengths array<bigint>, n int, lanes int, every int, states binary, places binary, words binary, crc bigint, "
    "ids_crc bigint"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
PIECES = "part int, ordinal bigint, doc_id bigint, at bigint, begun bigint, length bigint, crc bigint, whole boolean"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, h, n and ids (16 or 32 bits each) of each row of ``docs`` (doc_id, h, text); and, as
    rows with nothing but ``counts``, how often each task met every id (64 bits each)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = byte_bpe(path)
        wide = 2 if ids.code == "H" else 4
        end = end_id.to_bytes(wide, "little")
        counts = np.zeros(1, np.int64)
        gc.disable()  # words and ids make no cycles; looking for some would walk through all words kept
        try:
            for batch in batches:
                for a, b, texts in text_blocks(batch.column(2)):
                    found = [ids.of(t or "") + end for t in texts]
                    counts = _added(counts, np.frombuffer(b"".join(found), f"<u{wide}"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).cast(pa.int64()),
                            batch.column(1).slice(a, b - a),
                            pa.array([len(f) // wide for f in found], pa.int64()),
                            pa.array(found, pa.binary()),
                            pa.nulls(len(found), pa.binary()),
                        ],
                        names=["doc_id", "h", "n", "ids", "counts"],
                    )
        finally:
            gc.enable()
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "h", "n", "ids", "counts"]
        )

    schema = "doc_id bigint, h bigint, n bigint, ids binary, counts binary"
    return docs.select("doc_id", "h", "text").mapInArrow(released(encode), schema)


def _added(total: np.ndarray, ids: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """``total`` with the number of each id added, ``most`` ids at a time."""
    for at in range(0, len(ids), most):
        found = np.bincount(ids[at : at + most], minlength=len(total))
        found[: len(total)] += total
        total = found
    return total


def _ids(data: bytes, n: int) -> np.ndarray:
    """``n`` ids; the bytes of one follow from the numbers."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def frequencies(counts: DataFrame) -> pd.DataFrame:
    """symbol and count of all ids, from the ``counts`` of the tasks: one line for each id of the
    vocabulary at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, np.int64)
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        symbols = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(total[symbols])], names=["symbol", "count"])

    counted = counts.mapInArrow(released(spread), "symbol bigint, count bigint")
    return counted.groupBy("symbol").agg(F.sum("count").alias("count")).toPandas().sort_values("symbol")


class _Writer:
    """Collects the documents of one part and gives blocks."""

    def __init__(self, part: int, table: rans.Table, size: int, every: int):
        self.part, self.table, self.size, self.every = part, table, size, every
        self.block = self.first = self.ordinal = self.begun = self.held = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.size - self.held, len(ids) - at)
            self.doc_ids.append(doc_id)
            self.lengths.append(take)
            self.ids.append(ids[at : at + take])
            self.held += take
            at += take
            if self.held == self.size:
                yield self.flush(at if at < len(ids) else 0)

    def flush(self, begun: int = 0) -> tuple:
        """The block of what is held; ``begun`` ids of its last document if that goes on."""
        values = np.concatenate(self.ids)
        b = rans.encode(values, self.table, self.every)
        row = (
            self.part, self.block, self.first, self.ordinal, self.begun, begun > 0, self.doc_ids, self.lengths,
            b.n, b.lanes, b.every, b.states, b.places, b.words, b.crc, zlib.crc32(values.astype("<u4").tobytes()),
        )
        self.block += 1
        self.first += b.n
        self.ordinal += len(self.doc_ids) - (begun > 0)
        self.begun, self.held = begun, 0
        self.doc_ids, self.lengths, self.ids = [], [], []
        return row


@lru_cache(maxsize=1)
def _table(symbols: bytes, counts: bytes) -> rans.Table:
    return rans.Table(np.frombuffer(symbols, np.int64), np.frombuffer(counts, np.int64))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [
        pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block: int = BLOCK, every: int = 128
) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document followed by ``end_id``, to ``path``.

    Documents come in ascending doc_id, those without one last; rows that share an id are ordered
    by the hash of their text, and equal rows all stay. A null text is empty, a long one goes on
    over as many blocks as it needs. Extra columns are ignored. Ids are made once and kept in the
    shared folder, from which the frequencies are counted and the sorted blocks coded.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    ids = stored(tokenized(rows, tokenizer or default_tokenizer(), end_id), "token-ids")
    counts = frequencies(ids.where("counts IS NOT NULL").select("counts"))
    spark.createDataFrame(counts, "symbol bigint, count bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(
        (counts["symbol"].to_numpy(np.int64).tobytes(), counts["count"].to_numpy(np.int64).tobytes())
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(TaskContext.get().partitionId(), _table(*shared.value), block, every)
        for batch in batches:
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for row in writer.add(doc_id, _ids(data, n)):
                    yield _batch([row])
        if writer.held:
            yield _batch([writer.flush()])

    # Equal rows may be many: a number of the row lets their range be cut
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("row").asc()]
    dealt = ids.where("n IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "n", "ids").mapInArrow(released(code), SCHEMA).write.parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/blocks")


def pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document in each block: part, ordinal, doc_id, at (place in the part),
    begun, length, crc and whether it is the whole document; with its ids if asked for."""
    counts = spark.read.parquet(f"{path}/table").toPandas()  # a line for each id of the vocabulary at most
    counts = counts.sort_values("symbol")
    shared = spark.sparkContext.broadcast(
        (counts["symbol"].to_numpy(np.int64).tobytes(), counts["count"].to_numpy(np.int64).tobytes())
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(NAMES)}
                b = rans.Block(*(row[k] for k in ("n", "lanes", "every", "states", "places", "words", "crc")))
                data = rans.decode(b, _table(*shared.value)).astype("<u4").tobytes()
                if zlib.crc32(data) != row["ids_crc"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} decodes to other ids")
                yield _piece_rows(row, data, with_ids)

    return read_blocks(spark, path).mapInArrow(released(read), PIECES + (", ids binary" if with_ids else ""))


def _piece_rows(row: dict, data: bytes, with_ids: bool) -> pa.RecordBatch:
    lengths = np.array(row["lengths"], np.int64)
    k = len(lengths)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    begun = np.zeros(k, np.int64)
    begun[0] = row["begun"]
    whole = begun == 0
    whole[-1] &= not row["open"]
    view = memoryview(data)
    parts = [view[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    columns = [
        pa.array(np.full(k, row["part"], np.int32)), pa.array(row["ordinal"] + np.arange(k)),
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + starts), pa.array(begun), pa.array(lengths),
        pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(whole),
    ]
    names = [f.split()[0] for f in PIECES.split(", ")]
    if with_ids:
        columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


#: The polynomial of crc32, lowest power in the highest bit (fixed value).
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=64)
def _shift(power: int) -> int:
    """x^(8 * 2^power), the effect of 2^power zero bytes."""
    return 1 << 23 if not power else _times(_shift(power - 1), _shift(power - 1))


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings in a row, from (crc32, length) of each."""
    out = 0
    for crc, length in parts:
        power = 0
        while length:
            if length & 1:
                out = _times(_shift(power), out)
            length >>= 1
            power += 1
        out ^= crc
    return out


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and before: the ids of all parts before it. One short row for each file."""
    totals = read_blocks(spark, path).groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document.

    Documents inside one block are finished where it is decoded; only those that a block's edge
    cuts are put together, from a checksum for each of their blocks.
    """

    @F.pandas_udf("bigint")
    def whole_crc(lists: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([(p["crc"], 4 * p["length"]) for p in parts]) for parts in lists], dtype="int64")

    found = stored(pieces(spark, path), "token-pieces")
    one = found.where("whole").select("part", "doc_id", "at", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = (
        found.where("NOT whole")
        .groupBy("part", "ordinal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("at").alias("at"),
            F.sum("length").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("begun", "length", "crc"))).alias("parts"),
        )
    )
    cut = cut.select("part", "doc_id", "at", "n_tokens", whole_crc("parts").alias("ids_crc32"))
    return one.unionByName(cut).join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """The documents of ``docs`` as read back from files written to the shared folder."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, block)
    return read_documents(docs.sparkSession, path)
