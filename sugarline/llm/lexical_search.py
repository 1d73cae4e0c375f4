"""Ranked lexical search of many items at once, by shared subexpressions.

A document's score for an item is a sum over the item's terms, so items that have terms in common
have parts of their sums in common. Term sets that several items share are mined (the pair of terms
that most items hold becomes a node, and so on with nodes in place of terms), each node's scores of
a batch of documents are worked out once, and an item is a sum of few nodes.

Documents are read once: the query terms of each go to a table, from which the statistics are
counted and then the scores. Every task keeps the best documents of each item, and those of all
tasks are ranked in two steps.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sugarline.llm.common import blocks, released, small_batches, stored

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z in lower case.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Stands for a missing doc_id, which comes last among equal scores.
NO_ID = (1 << 63) - 1
#: Terms of a query set that is worked in one go, items of a block that is mined together, and
#: terms of an item that are paired with each other.
TERMS_A_PASS, ITEMS_A_BLOCK, TERMS_A_GROUP = 200_000, 256, 64
BATCH = 2048


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


@dataclass
class Plan:
    """Sums for a block of items. Symbols below ``width`` are terms; symbol width + i is the sum of
    the two symbols of ``nodes[i]``, which come before it. An item is the sum of its symbols."""

    width: int
    nodes: list[tuple[int, int]]
    items: list[tuple[int, list[int]]]

    def additions(self) -> int:
        return len(self.nodes) + sum(len(symbols) for _, symbols in self.items)


def mine(items: list[tuple[int, list[int]]], width: int, group: int = TERMS_A_GROUP) -> Plan:
    """Shared term sets of ``items`` (number, distinct terms).

    The pair of symbols that most items hold becomes a node that replaces it in all of them, until
    no pair is held twice. Terms of one item alone are in no pair; very long items are paired within
    groups of ``group`` terms, ordered by how many items have them.
    """
    held = Counter(t for _, own in items for t in own)
    parts: list[tuple[int, set[int]]] = []  # place of the item, some of its shared terms
    plan = Plan(width, [], [])
    for place, (number, own) in enumerate(items):
        shared = sorted((t for t in own if held[t] > 1), key=lambda t: (-held[t], t))
        parts += [(place, set(shared[i : i + group])) for i in range(0, len(shared), group)]
        plan.items.append((number, [t for t in own if held[t] == 1]))
    owners: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, (_, symbols) in enumerate(parts):
        ordered = sorted(symbols)
        for k, a in enumerate(ordered):
            for b in ordered[k + 1 :]:
                owners[a, b].add(i)
    heap = [(-len(found), pair) for pair, found in owners.items() if len(found) > 1]
    heapq.heapify(heap)
    while heap:
        count, pair = heapq.heappop(heap)
        found = owners[pair]
        if len(found) != -count:
            if len(found) > 1:
                heapq.heappush(heap, (-len(found), pair))
            continue
        node = width + len(plan.nodes)
        plan.nodes.append(pair)
        for i in list(found):
            symbols = parts[i][1]
            for gone in pair:
                symbols.discard(gone)
                for other in symbols:
                    owners[min(gone, other), max(gone, other)].discard(i)
            found.discard(i)
            for other in symbols:
                owners[other, node].add(i)
            symbols.add(node)
        for pair in {(other, node) for i in range(len(parts)) if node in parts[i][1] for other in parts[i][1]}:
            if len(owners[pair]) > 1:
                heapq.heappush(heap, (-len(owners[pair]), pair))
    for place, symbols in parts:
        plan.items[place][1].extend(sorted(symbols))
    return plan


class Best:
    """The ``k`` best (score, doc_id) of an item."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        scores, ids = np.concatenate([self.scores, scores[at]]), np.concatenate([self.ids, ids[at]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def evaluate(plan: Plan, columns: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of ``n`` documents) for each item; ``columns`` has for a term the documents
    that hold it and what it adds to their scores."""
    sums: list[np.ndarray] = []

    def add(total: np.ndarray, symbol: int) -> None:
        if symbol >= plan.width:
            total += sums[symbol - plan.width]
        elif symbol in columns:
            at, values = columns[symbol]
            total[at] += values

    for pair in plan.nodes:
        sums.append(np.zeros(n, np.int64))
        for symbol in pair:
            add(sums[-1], symbol)
    for number, symbols in plan.items:
        total = np.zeros(n, np.int64)
        for symbol in symbols:
            add(total, symbol)
        yield number, total


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (32 bits each) of the query terms of each row
    of ``docs`` that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(shared.value)}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, sizes, found, counts = [], [], [], []
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts[a:b], strict=True):
                    words = terms(text)
                    if not words:
                        continue
                    known = Counter(filter(number.__contains__, words))
                    ids.append(doc_id)
                    sizes.append(len(words))
                    found.append(np.fromiter(map(number.__getitem__, known), "<i4", len(known)).tobytes())
                    counts.append(np.fromiter(known.values(), "<i4", len(known)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(read), "doc_id bigint, n bigint, terms binary, counts binary")


def document_frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term; a task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=width)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    counted = rows.select("terms").mapInArrow(released(count), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    found = counted.toPandas()  # a row for each query term at most
    out = np.zeros(width, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def best_of_tasks(rows: DataFrame, plans: list[Plan], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id and score: the best ``k`` documents of each item in every task."""
    shared = rows.sparkSession.sparkContext.broadcast((plans, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, weight = shared.value
        best = {number: Best(k) for plan in plans for number, _ in plan.items}
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                ids = np.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], np.int64)
                size = batch.column(1).to_numpy()
                lists = batch.column(2).to_pylist()
                held = np.frombuffer(b"".join(lists), "<i4").astype(np.int64)
                counts = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in lists])
                m = 50 + 50 * size * documents // length
                value = weight[held] * (1_000_000_000 * counts // (1000 * counts + 20 * m[owner]))
                order = np.argsort(held, kind="stable")
                held, owner, value = held[order], owner[order], value[order]
                starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else []
                ends = [*starts[1:], len(held)]
                columns = {int(held[a]): (owner[a:b], value[a:b]) for a, b in zip(starts, ends, strict=bool(len(held)))}
                for plan in plans:
                    for number, scores in evaluate(plan, columns, len(ids)):
                        best[number].add(scores, ids)
        numbers = np.repeat(np.array(list(best), np.int64), [len(x.ids) for x in best.values()])
        scores = np.concatenate([x.scores for x in best.values()]) if best else np.zeros(0, np.int64)
        ids = np.concatenate([x.ids for x in best.values()]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item", "doc_id", "score"]
        )

    return rows.mapInArrow(released(score), "item bigint, doc_id bigint, score bigint")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and terms (distinct, ascending) of each item; rows with one item_id are one item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(set(terms(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(released(read), f"item_id {kind}, terms array<binary>")
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def _hash(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little")


def _alike(own: list[bytes]) -> int:
    """Equal for most items that have most terms in common."""
    return min((_hash(t) for t in own), default=0)


def plans_of(items: list[Row], vocabulary: dict[bytes, int], spark, block: int = ITEMS_A_BLOCK) -> list[Plan]:
    """Plans for the items (numbered by their place), alike ones in one block, each block mined by a
    task."""
    order = sorted(range(len(items)), key=lambda i: _alike(items[i].terms))
    numbered = [(i, [vocabulary[bytes(t)] for t in items[i].terms]) for i in order]
    packed = [numbered[i : i + block] for i in range(0, len(numbered), block)]
    width = len(vocabulary)
    frame = spark.createDataFrame(
        [(b, number, own) for b, part in enumerate(packed) for number, own in part], "block int, number int, own array<int>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for b, number, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[b].append((number, own))
        yield pa.RecordBatch.from_pydict({"plan": pa.array([pickle.dumps(mine(part, width)) for part in held.values()], pa.binary())})

    mined = frame.repartition(len(packed), "block").mapInArrow(released(work), "plan binary")
    return [pickle.loads(row.plan) for row in mined.collect()]


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, terms_a_pass: int = TERMS_A_PASS) -> DataFrame:
    """item_id, rank, doc_id and score: the best ``k`` rows of ``docs`` (doc_id, text) for each item
    of ``items`` (item_id, text), by score and then doc_id, those without one last.

    A row with equal ids and texts is ranked as often as it stands. Null texts and texts without
    terms count nowhere; items without terms, or whose terms no document has, get no rows. Items are
    worked in passes of about ``terms_a_pass`` terms (a longer item makes its pass longer), so the driver holds one
    pass of items and never documents; each pass reads the documents once. Extra columns are
    ignored; no documents or no items give no result.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = stored(item_terms(items).where(F.size("terms") > 0), "items")
    amount = wanted.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    passes = -(-amount // terms_a_pass)
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for i in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).orderBy("item_id").collect()
        if part:
            result = result.unionByName(_ranked_pass(docs, part, kind, k))
    return result


def _ranked_pass(docs: DataFrame, items: list[Row], kind: str, k: int) -> DataFrame:
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    vocabulary = sorted({bytes(t) for item in items for t in item.terms})
    rows = stored(postings(docs, vocabulary), "query-postings")
    size = rows.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    plans = plans_of(items, {t: i for i, t in enumerate(vocabulary)}, spark)
    weight = weights(document_frequencies(rows, len(vocabulary)), size.documents)
    found = best_of_tasks(rows, plans, weight, size.documents, max(size.length, 1), k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The tasks' bests meet in groups first, then the groups' bests
    found = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))
    found = found.withColumn("rank", first).where(F.col("rank") <= k)
    last = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    found = found.withColumn("rank", last).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item.item_id) for i, item in enumerate(items)], f"item bigint, item_id {kind}")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
