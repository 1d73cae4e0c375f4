"""Removal of byte strings that occur more than once, by suffix arrays.

Every window of ``SIZE`` bytes names an anchor: the smallest hash of the grams inside it, the
leftmost one on ties. Equal windows have equal anchors, so

1. runs of windows with one anchor (segments) are counted by anchor and by content. An anchor that
   occurs once has no repeated window. A segment whose content occurs twice is repeated as a whole.
2. Of anchors with several contents, one segment of each content goes to the shard of its anchor;
   anchors with very many are split by further anchors first. A shard sorts its segments' suffixes and compares neighbours; shards of one anchor that became
   too large for one sort are merged by binary search.
3. The repeated windows go back to all texts that hold the segment, and their bytes are removed.

Texts are identified by their md5: copies of a text share all results, and a text that occurs
twice is repeated as a whole.

Passages that several texts share are counted in words, as ``SIZE`` bytes may be more than a passage
has: windows of ``WORDS`` words name anchors in the same way, and hashes of whole windows are
compared only where an anchor has several contents. Such passages are shown, not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import released, small_batches, stored
from sugarline.llm.shingles import mixed
from sugarline.llm.suffixes import Shard

SIZE = 400
GRAM = 48
#: Low bits of a window key that hold the gram's place; texts are worked in blocks that fit.
PLACE_BITS = 22
#: Further orders that split an anchor, and how often it is split.
ORDERS, LEVELS = 3, 3
#: Words of a passage that texts may share, and of the runs that name its anchor.
WORDS, WORD_GRAM = 51, 8
_BYTE = np.random.default_rng(20240102).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables[name][:n]


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values``, each times a power of its place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", _BASE, len(values)), out=sums[1:])
    return sums


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` of the values."""
    sums = _sums(values)
    return mixed((sums[length:] - sums[:-length]) * _power("down", pow(_BASE, -1, 1 << 64), len(values) - length + 1))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` bytes."""
    return run_hashes(_BYTE[data], gram)


def word_hashes(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """Hash of each word (what stands between ASCII blanks) of a text, worked in blocks; a word that
    is longer than a block is hashed by itself."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        at, past = int(starts[i]), int(ends[j - 1])
        if past - at > block:
            out.append(np.array([_content(text[at:past])], np.int64).view(np.uint64))
        else:
            sums, first = _sums(_BYTE[data[at:past]]), starts[i:j] - at
            down = _power("down", pow(_BASE, -1, 1 << 64), past - at)
            out.append(mixed((sums[ends[i:j] - at] - sums[first]) * down[first]))
        i = j
    return np.concatenate(out)


def _window_minimum(values: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(text: bytes, size: int = SIZE, gram: int = GRAM, block: int = 1 << 20) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, first window, number of windows, whether windows may repeat inside) of a text."""
    for at in range(0, max(len(text) - size + 1, 0), block):
        data = np.frombuffer(text, np.uint8, min(block + size - 1, len(text) - at), at)
        anchors, starts, windows, inner = _runs(gram_hashes(data, gram), size - gram + 1)
        yield from zip(anchors.tolist(), (starts + at).tolist(), windows.tolist(), inner.tolist(), strict=True)


def word_segments(words: np.ndarray, size: int, gram: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays anchor, content, first window and number of windows of the :func:`segments` of a text
    that is given by the hashes of its words, block by block."""
    for at in range(0, max(len(words) - size + 1, 0), block):
        part = words[at : at + block + size - 1]
        anchors, starts, windows, _ = _runs(run_hashes(part, gram), size - gram + 1)
        sums, down = _sums(part), _power("down", pow(_BASE, -1, 1 << 64), len(part))
        content = mixed((sums[starts + windows + size - 1] - sums[starts]) * down[starts] + windows.view(np.uint64))
        yield anchors, content.view(np.int64), starts + at, windows


def _runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Arrays anchor, first window, number of windows, and whether windows may repeat inside, of the
    segments of a block; a window holds ``window`` grams."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    places = (_window_minimum(keys, window) & low).astype(np.int64)
    anchors = hashes[places]
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    ends = np.append(starts[1:], len(anchors))
    return anchors[starts].view(np.int64), starts, ends - starts, places[starts] != places[ends - 1]


def _content(part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def segment_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """anchor, content, key, start, windows, inner of the segments of each text; a batch gives a
    text once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in dict.fromkeys(batch.column(0).to_pylist()):
                data = (text or "").encode()
                if len(data) < size:
                    continue
                key = hashlib.md5(data).digest()
                for anchor, start, windows, inner in segments(data, size, gram):
                    part = data[start : start + windows + size - 1]
                    rows.append((anchor, _content(part), key, start, windows, inner))
            if rows:
                anchor, content, key, start, windows, inner = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor, pa.int64()),
                        pa.array(content, pa.int64()),
                        pa.array(key, pa.binary()),
                        pa.array(start, pa.int64()),
                        pa.array(windows, pa.int64()),
                        pa.array(inner, pa.bool_()),
                    ],
                    names=["anchor", "content", "key", "start", "windows", "inner"],
                )

    return docs.select("text").mapInArrow(
        released(cut), "anchor bigint, content bigint, key binary, start bigint, windows bigint, inner boolean"
    )


def word_segment_rows(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """anchor, content, key, start, windows of the segments of each text, counted in words; a batch
    gives a text once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for text in dict.fromkeys(batch.column(0).to_pylist()):
                data = (text or "").encode()
                if len(data) < 2 * words - 1:
                    continue
                for columns in word_segments(word_hashes(data), words, gram):
                    keys.append(hashlib.md5(data).digest())
                    found.append(columns)
            if keys:
                owner = np.repeat(np.arange(len(keys)), [len(columns[0]) for columns in found])
                anchor, content, start, windows = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))
                key = pa.array(keys, pa.binary()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [anchor, content, key, start, windows], names=["anchor", "content", "key", "start", "windows"]
                )

    return docs.select("text").mapInArrow(
        released(cut), "anchor bigint, content bigint, key binary, start bigint, windows bigint"
    )


def word_windows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key and window (hash) of the windows of the wanted segments (key, start, windows)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("places"))
    texts = docs.where(F.octet_length("text") >= 2 * words - 1).select(text_key(F.col("text")).alias("key"), "text")
    found = texts.join(lists, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, np.ndarray] = {}
            for key, text, places in zip(*batch.columns, strict=True):
                key = key.as_py()
                if key not in seen:  # copies of a text in one batch
                    hashes = run_hashes(word_hashes(text.as_py().encode()), words).view(np.int64)
                    seen[key] = np.unique(
                        np.concatenate([hashes[p["start"] : p["start"] + p["windows"]] for p in places.as_py()])
                    )
            if seen:
                owner = np.repeat(np.arange(len(seen)), [len(w) for w in seen.values()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.binary()).take(pa.array(owner)), pa.array(np.concatenate(list(seen.values())))],
                    names=["key", "window"],
                )

    return found.select("key", "text", "places").mapInArrow(released(cut), "key binary, window bigint")


def shared_passages(docs: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """key of each text that holds ``words`` words in a row which another text, not a copy of it,
    holds too. Blanks between the words may differ; letters are compared as they are."""
    name = F.xxhash64("key")  # numbers are aggregated without a sort
    rows = stored(word_segment_rows(docs, words, gram), "word-segments")
    several = rows.groupBy("anchor").agg((F.min(name) != F.max(name)).alias("several")).where("several")
    rows = stored(rows.join(several, "anchor", "left_semi"), "shared-anchors")
    contents = rows.groupBy("anchor", "content").agg(
        F.min(F.struct("key", "start", "windows")).alias("place"), (F.min("key") != F.max("key")).alias("shared")
    )
    contents = stored(contents, "word-contents")
    whole = rows.join(contents.where("shared"), ["anchor", "content"], "left_semi").select("key").distinct()
    whole = stored(whole, "whole-segments")
    # Texts without a shared segment may share windows inside of one
    unknown = rows.join(whole, "key", "left_anti").select("anchor").distinct()
    wanted = stored(contents.join(unknown, "anchor", "left_semi").select("place.*"), "word-places")
    windows = stored(word_windows(docs, wanted, words), "word-windows")
    shared = windows.groupBy("window").agg((F.min(name) != F.max(name)).alias("shared")).where("shared")
    return whole.unionByName(windows.join(shared, "window", "left_semi").select("key")).distinct()


def suspects(rows: DataFrame) -> DataFrame:
    """anchor, content, twice, several, and one place (key, start, windows) of each content, for all
    contents that may hold a repeated window."""
    place = F.struct("key", "start", "windows")
    contents = rows.groupBy("anchor", "content").agg(
        F.min(place).alias("place"), (F.min(place) != F.max(place)).alias("twice"), F.max("inner").alias("inner")
    )
    contents = stored(contents, "contents")
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("contents"))
    several = (F.col("contents") > 1) | (F.col("inner") & ~F.col("twice"))
    return (
        contents.join(anchors.where("contents > 1"), "anchor", "left")
        .select("anchor", "content", "twice", F.coalesce(several, F.lit(False)).alias("several"), "place.*")
        .where("twice OR several")
    )


def segment_bytes(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """anchor, content, part (bytes) of the wanted segments, cut from their texts."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "start", "windows")).alias("places"))
    texts = docs.where(F.octet_length("text") >= size).select(text_key(F.col("text")).alias("key"), "text")
    found = texts.join(lists, "key").select("text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            rows = []
            for text, places in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode()
                for place in places.as_py():
                    name = (place["anchor"], place["content"])
                    if name not in seen:  # copies of a text in one batch
                        seen.add(name)
                        rows.append((*name, data[place["start"] : place["start"] + place["windows"] + size - 1]))
            anchor, content, part = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(part, pa.binary())],
                names=["anchor", "content", "part"],
            )

    return found.mapInArrow(released(cut), "anchor bigint, content bigint, part binary")


def split_segments(parts: DataFrame, size: int, gram: int, level: int) -> DataFrame:
    """Sub-segments of segments (anchor, content, part): under, content, anchor, above (content of
    the segment), offset, windows, inner, part.

    Windows of one anchor are told apart by the smallest grams under ``ORDERS`` further orders of
    hash values, which equal windows share as well. What stands around a common passage differs, so
    its windows part as soon as one of the orders chooses a gram outside of it.
    """
    seeds = np.random.default_rng([20240103, level]).integers(1, 1 << 63, ORDERS, dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, content, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = gram_hashes(np.frombuffer(part, np.uint8), gram)
                n = len(part) - size + 1
                under = np.full(n, np.int64(anchor)).view(np.uint64)
                places = []
                for seed in seeds:
                    keys = (mixed(hashes ^ seed) & ~low) | np.arange(len(hashes), dtype=np.uint64)
                    places.append((_window_minimum(keys, size - gram + 1) & low).astype(np.int64))
                    under = mixed(under * np.uint64(31) + hashes[places[-1]])
                starts = np.flatnonzero(np.concatenate([[True], under[1:] != under[:-1]]))
                ends = np.append(starts[1:], n)
                still = np.logical_and.reduce([p[starts] != p[ends - 1] for p in places])
                for a, b, name, inner in zip(
                    starts.tolist(), ends.tolist(), under[starts].view(np.int64).tolist(), still.tolist(), strict=True
                ):
                    piece = part[a : b + size - 1]
                    rows.append((name, _content(piece), anchor, content, a, b - a, inner, piece))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["under", "content", "anchor", "above", "offset", "windows", "inner", "part"],
            )

    schema = "under bigint, content bigint, anchor bigint, above bigint, offset bigint, windows bigint, inner boolean, part binary"
    return parts.select("anchor", "content", "part").mapInArrow(released(cut), schema)


def repeated_windows(parts: DataFrame, size: int, gram: int, shard_bytes: int = 1_000_000, level: int = 0) -> DataFrame:
    """anchor, content, first, past: runs of window starts in a segment that occur elsewhere.

    An anchor with more than a shard of segments (the edge of a very common passage) is split by
    further anchors inside its windows, again if need be, up to ``LEVELS`` times; so no task holds
    all of it.
    """
    sizes = parts.groupBy("anchor").agg(F.sum(F.octet_length("part")).alias("bytes"))
    hot = stored(sizes.where(F.col("bytes") > shard_bytes).select("anchor"), "hot-anchors")
    if level == LEVELS or hot.isEmpty():
        return sorted_windows(parts, size, shard_bytes)
    cold = sorted_windows(parts.join(hot, "anchor", "left_anti").select(parts.columns), size, shard_bytes)
    wide = parts.join(hot, "anchor").dropDuplicates(["anchor", "content"])
    subs = stored(split_segments(wide, size, gram, level), "sub-segments")
    place = F.struct("anchor", "above", "offset")
    contents = subs.groupBy("under", "content").agg(
        F.min(place).alias("place"), (F.min(place) != F.max(place)).alias("twice"),
        F.max("inner").alias("inner"), F.max("windows").alias("windows"),
    )
    contents = stored(contents, "sub-contents")
    several = contents.groupBy("under").agg(F.count("*").alias("contents"))
    wanted = contents.join(several, "under").where("contents > 1 OR (inner AND NOT twice)")
    wanted = wanted.select("under", "content", "place.anchor", "place.above", "place.offset")
    chosen = subs.join(wanted, ["under", "content", "anchor", "above", "offset"], "left_semi")
    chosen = stored(chosen.select(F.col("under").alias("anchor"), "content", "part"), "sub-parts")
    runs = repeated_windows(chosen, size, gram, shard_bytes, level + 1).withColumnRenamed("anchor", "under")
    twice = contents.where("twice").select("under", "content", F.lit(0).cast("long").alias("first"), F.col("windows").alias("past"))
    marks = twice.unionByName(runs.join(twice.select("under", "content"), ["under", "content"], "left_anti"))
    back = subs.drop("part").join(marks, ["under", "content"]).select(
        "anchor", F.col("above").alias("content"), (F.col("offset") + F.col("first")).alias("first"),
        (F.col("offset") + F.col("past")).alias("past"),
    )
    return cold.unionByName(back)


def sorted_windows(parts: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """:func:`repeated_windows` by suffix arrays.

    A task sees its anchors one after the other. Anchors are sorted together until they make a
    shard; an anchor that is larger makes several shards, which are merged pairwise.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        """All segments of one anchor at a time, split where they exceed a shard."""
        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []
        amount = 0
        for group in groups(batches):
            group = list({row[1]: row for row in group}.values())
            total = sum(len(row[2]) for row in group)
            if total > shard_bytes:
                yield from _merged(group, size, shard_bytes)
                continue
            if amount + total > shard_bytes:
                yield from _merged(waiting, size, shard_bytes)
                waiting, amount = [], 0
            waiting += group
            amount += total
        if waiting:
            yield from _merged(waiting, size, shard_bytes)

    dealt = parts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(released(sort), "anchor bigint, content bigint, first bigint, past bigint")


def _merged(rows: list[tuple[int, int, bytes]], size: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    cuts, amount = [0], 0
    for i, row in enumerate(rows):
        if amount + len(row[2]) > shard_bytes and i > cuts[-1]:
            cuts.append(i)
            amount = 0
        amount += len(row[2])
    bounds = list(zip(cuts, [*cuts[1:], len(rows)], strict=True))
    shards = [Shard([row[2] for row in rows[a:b]], size) for a, b in bounds]
    for i, shard in enumerate(shards):
        for other in shards[:i]:
            shard.meet(other)
    out = []
    for (a, b), shard in zip(bounds, shards, strict=True):
        for row, runs in zip(rows[a:b], shard.intervals(), strict=True):
            out += [(row[0], row[1], first, past) for first, past in runs]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["anchor", "content", "first", "past"]
    )


def without_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_bytes: int = 1_000_000, words: int = WORDS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and shares_passage for each row of ``docs``
    (doc_id, text).

    Removes every byte of a ``size``-byte string that also starts elsewhere in any text.
    ``shares_passage`` says whether the text holds ``words`` words in a row that the text of another
    row holds too, be they removed or, with fewer bytes than ``size``, not. Null texts count as empty; repeated rows are texts that occur twice; null ids stay null; extra columns are
    ignored; no rows give no result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(segment_rows(docs, size, gram), "segment-rows")
    found = stored(suspects(rows), "suspects")
    parts = stored(segment_bytes(docs, found.where("several"), size), "segments")
    runs = stored(repeated_windows(parts, size, gram, shard_bytes), "runs")
    whole = found.where("twice").select("anchor", "content", F.lit(0).cast("long").alias("first"), F.col("windows").alias("past"))
    partial = runs.join(found.where("twice").select("anchor", "content"), ["anchor", "content"], "left_anti")
    marks = whole.unionByName(partial)
    ranges = (
        rows.join(marks, ["anchor", "content"])
        .select("key", (F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("past") + size - 1).alias("to"))
        .groupBy("key")
        .agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    )
    copies = docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.count("*").alias("copies")).where("copies > 1")
    passages = shared_passages(docs, words, min(WORD_GRAM, words)).withColumn("passage", F.lit(True))
    marked = stored(ranges.join(copies, "key", "full").join(passages, "key", "full"), "removals")
    keyed = docs.withColumn("key", text_key(F.col("text")))
    joined = keyed.join(marked, "key", "left").select("doc_id", "text", "ranges", (F.col("copies") > 1).alias("copied"), "passage")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges, copied, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                if copied and len(data) >= size:
                    ranges = [{"from": 0, "to": len(data)}]
                kept, at, removed, spans, past = [], 0, 0, 0, -1
                for r in sorted(ranges or [], key=lambda r: (r["from"], r["to"])):
                    if r["from"] > past:
                        spans += 1
                    if r["from"] > at:
                        kept.append(data[at : r["from"]])
                    removed += max(0, r["to"] - max(at, r["from"]))
                    at = max(at, r["to"])
                    past = max(past, r["to"])
                kept.append(data[at:])
                shares = bool(passage or (copied and len(word_hashes(data)) >= words))
                out.append((doc_id, len(data), removed, spans, b"".join(kept), shares))
            doc_id, n_bytes, n_removed, n_spans, kept, shares = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_id, pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                    pa.array(shares, pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "shares_passage"],
            )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, shares_passage boolean"
    return joined.mapInArrow(released(remove), schema)
