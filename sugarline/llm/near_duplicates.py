"""N-gram Jaccard join with several global token orders.

Two sets with a Jaccard similarity of t or more share a token among the first
``n - ceil(t n) + 1`` tokens of each, in whichever order all tokens are put. So a candidate has to
pass under several different orders before its whole sets are compared:

1. Under the order of hash values, with the prefix made longer by a share of n; a set then shares
   that many more tokens with other sets. Most texts fail here and their sets are never shipped.
2. Under the order of document frequencies among the texts that are left, rare tokens first, ties
   by hash. A token that no other set has fills a place of the prefix and makes no candidates.
3. Under the descending order of hash values, for the pairs that order 2 leaves.

Texts with the same words form a class, and only classes are compared. The join wants components:
a set is first compared with one pivot of its shared tokens, components are merged, and only pairs
of different components are left for the next pass. The last pass joins whatever is left, so no
link between components is lost, while groups of many near copies never meet pair by pair.

Tokens travel packed: a batch of texts sends each range of hash values (bucket) one row with the
tokens in it, in a few bytes each, and the tasks that count them work on whole arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sugarline.llm.common import released, small_batches, stored, text_blocks
from sugarline.llm.shingles import canonical, mixed, shingle_sets

#: Ids of classes without any doc_id start here; counts of frequent tokens lie below the other value.
NAMELESS, COUNTS = 1 << 62, -(1 << 62)


#: The owner of a token that several classes have, which is no class.
SEVERAL = -(1 << 63)


def _class_key(text: bytes) -> int:
    key = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
    return key if key != SEVERAL else 0


def class_key(text: Column) -> Column:
    """The class of a text, null without words."""

    @F.pandas_udf("bigint")
    def compute(texts: pd.Series) -> pd.Series:
        words = [canonical(t) for t in texts]
        return pd.Series([_class_key(w) if w else None for w in words], dtype="Int64")

    return compute(text)


def _needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def _batches(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and class (a hash of the words; null without words) of each row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw in text_blocks(batch.column(1)):
                texts = [canonical(t) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array([len(s) for s in shingle_sets(texts)], pa.int64()),
                        pa.array([_class_key(t) if t else None for t in texts], pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "class"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(describe), "doc_id bigint, n_shingles bigint, class bigint")


def _buckets(spark: SparkSession) -> int:
    """Bits of a token that name its bucket: four buckets or more for each shuffle partition."""
    return (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _pack(tokens: np.ndarray, owners: np.ndarray, wide: int) -> np.ndarray:
    """Rows of bytes: five of each token, then ``wide`` of each owner."""
    out = np.empty((len(tokens), 5 + wide), np.uint8)
    out[:, :5] = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = owners.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide]
    return out


def _unpack(data: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(data, np.uint8).reshape(-1, 5 + wide)
    tokens, owners = np.zeros((len(packed), 8), np.uint8), np.zeros((len(packed), 8), np.uint8)
    tokens[:, :5] = packed[:, :5]
    owners[:, :wide] = packed[:, 5:]
    return tokens.view("<u8").ravel(), owners.view("<i8").ravel()


def _bucket_rows(tokens: np.ndarray, owners: np.ndarray, bits: int, wide: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed tokens and owners); tokens are ascending. A packed token is the 40 bits below
    the bucket's, which is exact enough to say which texts may share something."""
    bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    packed = _pack((tokens >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1), owners, wide)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield int(bucket[a]), packed[a:b].tobytes()


def _by_bucket(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """All packed bytes of one bucket at a time; rows without any go to ``passed``."""
    bucket, held = None, []
    for batch in batches:
        alone = pc.is_null(batch.column("data"))
        passed.append(batch.filter(alone))
        packed = batch.filter(pc.invert(alone))
        for name, data in zip(packed.column("bucket").to_pylist(), packed.column("data").to_pylist(), strict=True):
            if name != bucket:
                if held:
                    yield bucket, b"".join(held)
                bucket, held = name, []
            held.append(data)
    if held:
        yield bucket, b"".join(held)


def _groups(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the tokens, starts of equal ones in it, and the group of each place in it."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return order, np.flatnonzero(first), np.cumsum(first) - 1


#: Bytes of text whose prefix tokens are sent together.
PREFIX_BYTES = 4_000_000


def prefix_rows(docs: DataFrame, percent: int, longer: float, bits: int) -> DataFrame:
    """Prefix tokens under the order of hash values: rows (bucket, data), and for each class of a
    block of texts (class, found, needed): the prefix tokens that it shares within the block, and how
    many it has to share in all.

    A block sends a token once: with its class if one class has it, else as a token of several. So
    a token of very many texts travels once for each block.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in (raw for batch in batches for _, _, raw in text_blocks(batch.column(0), PREFIX_BYTES)):
            texts = [t for t in dict.fromkeys(canonical(t) for t in raw) if t]
            if not texts:
                continue
            keys = np.array([_class_key(t) for t in texts], np.int64)
            prefixes, needed = [], []
            for tokens in shingle_sets(texts):
                n = len(tokens)
                extra = int(longer * n)
                prefixes.append(tokens[: min(n, n - _needed(n, percent) + 1 + extra)])
                needed.append(extra + 1)
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in prefixes])
            tokens = np.concatenate(prefixes)
            order, starts, group = _groups(tokens)
            tokens, owner = tokens[order], owner[order]
            several = np.diff(np.append(starts, len(tokens))) > 1
            here = np.bincount(owner[several[group]], minlength=len(texts))
            sent = np.where(several, SEVERAL, keys[owner[starts]])
            rows = list(_bucket_rows(tokens[starts], sent, bits, 8))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([r[0] for r in rows], pa.int32()),
                    "data": pa.array([r[1] for r in rows], pa.binary()),
                    "class": pa.nulls(len(rows), pa.int64()),
                    "found": pa.nulls(len(rows), pa.int64()),
                    "needed": pa.nulls(len(rows), pa.int64()),
                }
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array((keys & ((1 << bits) - 1)).astype(np.int32)),
                    "data": pa.nulls(len(texts), pa.binary()),
                    "class": pa.array(keys),
                    "found": pa.array(here.astype(np.int64)),
                    "needed": pa.array(np.array(needed, np.int64)),
                }
            )

    schema = "bucket int, data binary, class bigint, found bigint, needed bigint"
    return docs.select("text").mapInArrow(released(post), schema)


def surviving_classes(docs: DataFrame, percent: int, longer: float = 0.15) -> DataFrame:
    """``key`` of the classes that share enough prefix tokens with others.

    A class that occurs in several blocks counts its shared and its needed tokens in each of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for _, data in _by_bucket(batches, passed):
            tokens, owners = _unpack(data, 8)
            order, starts, group = _groups(tokens)
            owners = owners[order]
            shared = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
            keys, found = np.unique(owners[shared[group] & (owners != SEVERAL)], return_counts=True)
            zero = np.zeros(len(keys), np.int64)
            yield _batches({"key": keys, "found": found.astype(np.int64), "needed": zero})
        for batch in passed:
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["key", "found", "needed"])

    rows = prefix_rows(docs, percent, longer, _buckets(docs.sparkSession))
    counted = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        released(count), "key bigint, found bigint, needed bigint"
    )
    return (
        counted.groupBy("key")
        .agg(F.sum("found").alias("found"), F.sum("needed").alias("needed"))
        .where("found >= needed")
        .select("key")
    )


def class_sets(docs: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """doc_id, class, n and tokens of the texts of ``docs`` (doc_id, text), of those only whose id's
    bit is set in ``wanted`` if given (see :func:`bitmap_of`).

    The test stands in the same function as the sets, so that a task needs one Python worker.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((wanted.value[at >> 6] >> (at & 63)) & 1 == 1))
            for a, b, raw in text_blocks(batch.column(1), PREFIX_BYTES):
                texts = [canonical(t) for t in raw]
                sets = [s.view(np.int64) for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([_class_key(t) if t else None for t in texts], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "class", "n", "tokens"],
                )

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), "text", place_of(F.col("doc_id")).alias("place")]
    found = docs.select(*columns).mapInArrow(released(build), "doc_id bigint, class bigint, n bigint, tokens array<bigint>")
    return found.where("class IS NOT NULL")


def _by_tokens(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in ranges of about ``most`` tokens (column 1)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        past = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, past - start)
        start = past


def shared_tokens(sets: DataFrame, often: int = 16, piece: int = 20_000, most: int = 1_000_000) -> DataFrame:
    """(id, token, df) of the tokens that two sets or more have.

    Tokens that a range of sets (of about ``most`` tokens) has ``often`` times do not all go to the
    token's bucket: that gets their count, and the range's (id, token) go elsewhere in pieces of
    ``piece``, to meet the df later.
    """
    bits = _buckets(sets.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_tokens(whole, most)):
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            if not len(tokens):
                continue
            order, starts, group = _groups(tokens)
            tokens, owner = tokens[order], owner[order]
            counts = np.diff(np.append(starts, len(tokens)))
            hot = counts >= often
            rare = ~hot[group]
            # The count of a frequent token goes in place of an owner
            sent = np.concatenate([tokens[rare], tokens[starts[hot]]])
            owners = np.concatenate([owner[rare], COUNTS - counts[hot]])
            by_token = np.argsort(sent, kind="stable")
            rows = list(_bucket_rows(sent[by_token], owners[by_token], bits, 8))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([r[0] for r in rows], pa.int32()),
                    "data": pa.array([r[1] for r in rows], pa.binary()),
                    "frequent": pa.nulls(len(rows), pa.binary()),
                }
            )
            pairs = np.stack([owner[~rare], (tokens[~rare] >> np.uint64(24 - bits)).astype(np.int64)], axis=1)
            pieces = [pairs[i : i + piece] for i in range(0, len(pairs), piece)]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([int(p[0, 1] & ((1 << bits) - 1)) for p in pieces], pa.int32()),
                    "data": pa.nulls(len(pieces), pa.binary()),
                    "frequent": pa.array([p.tobytes() for p in pieces], pa.binary()),
                }
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for bucket, data in _by_bucket(batches, passed):
            for batch in passed:
                yield _named(batch)
            passed.clear()
            tokens, owners = _unpack(data, 8)
            order, starts, group = _groups(tokens)
            owners = owners[order]
            df = np.add.reduceat(np.where(owners < COUNTS, COUNTS - owners, 1), starts)
            hot = np.minimum.reduceat(owners, starts) < COUNTS
            whole = (tokens[order] | (np.uint64(bucket) << np.uint64(40))).astype(np.int64)
            kept = (df > 1)[group] & (owners > COUNTS)
            yield _batches({"id": owners[kept], "token": whole[kept], "df": df[group][kept].astype(np.int64)})
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(int(hot.sum()), pa.int64()), pa.array(whole[starts[hot]]), pa.array(df[hot].astype(np.int64))],
                names=["id", "token", "df"],
            )
        for batch in passed:
            yield _named(batch)

    def _named(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(batch.column("frequent").to_pylist()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["id", "token", "df"]
        )

    rows = sets.select("id", "tokens").mapInArrow(released(post), "bucket int, data binary, frequent binary")
    found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(count), "id bigint, token bigint, df bigint")
    found = stored(found, "shared")
    hot = found.where("id IS NULL").select("token", "df")
    waiting = found.where("df IS NULL").select("id", "token")
    return found.where("id IS NOT NULL AND df IS NOT NULL").unionByName(waiting.join(hot, "token"))


def rare_prefixes(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(id, n, token, place): shared tokens in the prefix of each set under the order of frequencies.

    Tokens that no other set has come first and are not listed; ``place`` counts them. ``sizes``
    has id and n.
    """
    lists = shared_tokens(sets).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    room = F.size("shared") - F.ceil(percent * F.col("n") / 100) + 1
    return (
        lists.join(sizes, "id")
        .withColumn("room", room.cast("int"))
        .where("room > 0")
        .withColumn("alone", F.greatest(F.col("n") - F.size("shared"), F.lit(0)))
        .select("id", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("at", "t"))
        .select("id", "n", "t.token", (F.col("alone") + F.col("at") + 1).alias("place"))
    )


def may_link(a: Column, a_place: Column, b: Column, b_place: Column, percent: int) -> Column:
    """Whether two sets of sizes ``a`` and ``b`` can be similar enough if a token at these places is
    the first that they share: only it and what comes after it in both can be common."""
    most = 1 + F.least(a - a_place, b - b_place)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * most >= percent * (a + b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """The pairs (a, b), with ``more`` columns of theirs, whose sets are similar enough: their
    prefixes meet under the ascending and the descending order of hash values, then the whole sets
    are compared."""
    both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
    size = lambda s: (F.col(f"{s}.n") - F.ceil(percent * F.col(f"{s}.n") / 100) + 1).cast("int")
    head = lambda s: F.slice(f"{s}.tokens", F.lit(1), size(s))
    tail = lambda s: F.slice(f"{s}.tokens", -size(s), size(s))
    meet = F.arrays_overlap(head("x"), head("y")) & F.arrays_overlap(tail("x"), tail("y"))
    common = F.size(F.array_intersect("x.tokens", "y.tokens"))
    linked = 100 * common >= percent * (F.col("x.n") + F.col("y.n") - common)
    return both.where(meet).where(linked).select("a", "b", *more)


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of all nodes that have an edge (a, b).

    Every node points to its smallest neighbour, pointers are followed twice, and the edges between
    different roots go on; each pass at least halves the nodes that are left.
    """
    passes = []
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        parents = ends.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root"))
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        parents = parents.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        passes.append(stored(parents, "parents"))
        a = passes[-1].select(F.col("node").alias("a"), F.col("root").alias("to_a"))
        b = passes[-1].select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = stored(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    mapping = passes[0]
    for parents in passes[1:]:
        new = parents.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        mapping = mapping.join(new, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
    return stored(mapping, "roots") if len(passes) > 1 else mapping


def linked_components(
    sets: DataFrame, sizes: DataFrame, percent: int, pivot_passes: int = 2, more: DataFrame | None = None
) -> DataFrame:
    """node and root of all sets (id, n, tokens) that have a partner. Ids must be unique; ``more``
    holds further links (a, b).

    In a pivot pass each set meets the pivot with which it shares most tokens: of all sets with a
    token, the one whose group comes first by hash. Groups that a link connects become one. The last
    pass compares all sets of a token that are still in different groups. Groups only spare
    comparisons; the components come from the links.
    """
    postings = stored(rare_prefixes(sets, sizes, percent), "postings")
    shared = postings.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token")
    labels = postings.join(shared, "token").withColumn("root", F.col("id"))
    labels = stored(labels.select("id", "n", "token", "place", "root"), "shared-postings")
    links = [] if more is None else [more]
    for _ in range(pivot_passes):
        first = F.min(F.struct(F.xxhash64("root").alias("h"), "root", "id", "n", "place"))
        pivots = labels.groupBy("token").agg(first.alias("p"))
        near = may_link(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), percent)
        near = near & (F.col("root") != F.col("p.root"))
        pairs = (
            labels.join(pivots, "token")
            .where(near)
            .groupBy("id", "root", F.col("p.id").alias("pivot"), F.col("p.root").alias("pivot_root"))
            .agg(F.count("*").alias("common"))
            .groupBy("id", "root")
            .agg(F.max(F.struct("common", "pivot", "pivot_root")).alias("best"))
            .select("id", "root", F.col("best.pivot").alias("pivot"), "best.pivot_root")
        )
        met = verified(pairs.withColumns({"a": F.col("id"), "b": F.col("pivot")}), sets, percent, "root", "pivot_root")
        met = stored(met, "pivot-links")
        links.append(met.select("a", "b"))
        # A group joins the first group by hash that it has a link to, and takes that one's own step
        order = F.struct(F.xxhash64("pivot_root"), "pivot_root")
        steps = met.groupBy("root").agg(F.min(order)["pivot_root"].alias("to"))
        after = steps.select(F.col("root").alias("to"), F.col("to").alias("then"))
        steps = steps.join(after, "to", "left").select("root", F.coalesce("then", "to").alias("to"))
        labels = labels.join(steps, "root", "left").select(
            "id", "n", "token", "place", F.coalesce("to", "root").alias("root")
        )
        labels = stored(labels, "grouped-postings")
    other = labels.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "place", "root")])
    near = may_link(F.col("n"), F.col("place"), F.col("n_b"), F.col("place_b"), percent)
    pairs = (
        labels.join(other, "token")
        .where((F.col("root") < F.col("root_b")) & near)
        .select(F.col("id").alias("a"), F.col("id_b").alias("b"))
        .distinct()
    )
    links.append(stored(verified(pairs, sets, percent), "last-links"))
    return components(reduce(DataFrame.union, links))


#: Bits that name a bit of a bitmap: 2 MB whatever the data; with very many keys it lets more by.
PLACE_BITS = 24


def place_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << PLACE_BITS))


def bitmap_of(keys: DataFrame) -> Broadcast:
    """A bit for the place of each of the values of the one column of ``keys``.

    Tested before a semi-join, it keeps most rows without a partner out of the shuffle.
    """
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    words = keys.select(place_of(F.col(keys.columns[0])).alias("place"))
    words = words.select(F.shiftright("place", 6).alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("set")).toPandas()
    bitmap = np.zeros(1 << PLACE_BITS - 6, np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, class and root (node id of the component) of each row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = stored(classes_of(docs), "classes")
    nameless = F.lit(NAMELESS) + F.pmod(F.col("class"), F.lit(1 << 61))
    worded = known.where("class IS NOT NULL")
    repeated = (
        worded.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.count("*").alias("rows"), (F.min("class") != F.max("class")).alias("several"))
        .where("rows > 1")
    )
    repeated = stored(repeated.select("doc_id", "several"), "repeated-ids")
    ids_repeat = not repeated.isEmpty()
    heads = worded.groupBy("class", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("head"))
    if ids_repeat:
        heads = heads.join(repeated.withColumnRenamed("doc_id", "head"), "head", "left")
    else:
        heads = heads.withColumn("several", F.lit(None).cast("boolean"))
    # A set is named by its smallest id, or by its class if that id has other sets too
    own_id = F.when(F.col("several"), nameless).otherwise(F.coalesce("head", nameless)).alias("id")
    heads = stored(heads.select("class", "n", "head", own_id, F.col("several").isNotNull().alias("repeats")), "heads")
    surviving = surviving_classes(docs, percent).withColumnRenamed("key", "class")
    chosen = stored(heads.join(surviving, "class"), "chosen")

    # One text of each class: that of its smallest id; classes without ids are looked for by class
    def named(own: DataFrame) -> DataFrame:
        wanted = own.select(F.col("head").alias("doc_id")).distinct()
        return class_sets(docs, bitmap_of(wanted)).join(wanted, "doc_id", "left_semi").drop("doc_id")

    unnamed = class_sets(docs.where("doc_id IS NULL")).dropDuplicates(["class"]).drop("doc_id")
    once, again = chosen.where("head IS NOT NULL AND NOT repeats"), chosen.where("repeats")
    sets = named(once).join(once.select("class", "id"), "class").unionByName(
        unnamed.join(chosen.where("head IS NULL").select("class", "id"), "class")
    )
    same_id = None
    if ids_repeat:
        # Rows that repeat an id may hold a class in several partitions
        sets = sets.unionByName(named(again).dropDuplicates(["class"]).join(again.select("class", "id"), "class"))
        same_id = worded.join(repeated.where("several"), "doc_id", "left_semi").select("doc_id", "class").distinct()
        same_id = same_id.join(heads.select("class", "id"), "class").where("id <> doc_id")
        same_id = stored(same_id.select(F.col("id").alias("a"), F.col("doc_id").alias("b")), "same-id")
    sets = stored(sets.select("id", "n", "tokens"), "sets")
    roots = linked_components(sets, chosen.select("id", "n").distinct(), percent, more=same_id)
    root = F.coalesce(F.col("root"), F.col("id"))
    labels = heads.join(roots, F.col("id") == F.col("node"), "left").select("class", root.alias("root"))
    return known.join(labels, "class", "left").select("doc_id", "n_shingles", "class", "root")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles, link with nothing and are their own
    component. Rows without doc_id take part; their component_id is the smallest doc_id that they
    reach, null if there is none. Rows that share a doc_id are one node. Ids must lie within 2^62.
    Extra columns are ignored; no rows give no result.
    """
    return labelled(docs, percent).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("root") < NAMELESS, F.col("root")).when(F.col("root").isNull(), F.col("doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: one whose doc_id is the
    component's smallest. Rows without words stay. Of repeated rows, and of a component without any
    doc_id, one row stays.
    """
    found = stored(labelled(docs, percent), "labelled")
    named = docs.where("doc_id IS NOT NULL")
    named = named.join(stored(found.where("doc_id <> root").select("doc_id").distinct(), "duplicates"), "doc_id", "left_anti")
    named = named.select(docs.columns)
    worded = found.where("root IS NOT NULL AND doc_id IS NOT NULL")
    repeated = stored(worded.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        once = named.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
        named = named.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    nameless = found.where("doc_id IS NULL").select("class", "root").distinct()
    if nameless.isEmpty():
        return named
    roots = nameless.where(F.col("root").isNotNull()).select(F.col("class").alias("__class"), F.col("root").alias("__root"))
    keyed = docs.where("doc_id IS NULL").withColumn("__class", class_key(F.col("text")))
    keyed = keyed.join(roots, "__class", "left")
    kept = keyed.where("__root IS NULL").unionByName(keyed.where(F.col("__root") >= NAMELESS).dropDuplicates(["__root"]))
    return named.unionByName(kept.select(docs.columns))
