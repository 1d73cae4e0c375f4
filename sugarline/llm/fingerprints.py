"""Winnowing fingerprints; DataFrame functions only.

A text is a sequence of words. Every run of ``GRAM`` words gets a rolling hash; of every ``WINDOW``
consecutive hashes the smallest is selected, the rightmost one on ties, and kept with its place. So
any passage of ``GRAM + WINDOW - 1`` words that two texts share leaves a common selected hash, and
no gap between selected places exceeds ``WINDOW``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sugarline.llm.common import native_words, stored
from sugarline.llm.quality_rules import let

GRAM, WINDOW = 3, 6
#: Low bits of a window key that hold the place of the hash.
PLACE_BITS = 26


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Struct of the selected hashes and of their places, both by place. Null and wordless texts
    have none; a text of fewer than ``gram`` words has one hash, of all its words."""
    low = (1 << PLACE_BITS) - 1

    def select(hashes: Column) -> Column:
        # The place counts down in the low bits, so that the smallest key is the rightmost one
        key = lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(low) - i.cast("long"))
        smallest = lambda keys: F.when(
            F.size(keys) <= window, F.array(F.array_min(keys))
        ).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(keys) - (window - 1)), lambda i: F.array_min(F.slice(keys, i, window))
            )
        )
        place = lambda k: (F.lit(low) - k.bitwiseAND(F.lit(low))).cast("int")
        chosen = let(F.transform(hashes, key), lambda keys: F.array_distinct(smallest(keys)))
        return let(
            F.transform(chosen, place),
            lambda at: F.struct(F.transform(at, lambda i: F.get(hashes, i)).alias("hash"), at.alias("place")),
        )

    def grams(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (gram - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(words, i, gram)),
        )

    none = F.expr("named_struct('hash', CAST(array() AS array<bigint>), 'place', CAST(array() AS array<int>))")
    return let(native_words(text), lambda w: F.when(F.size(w) == 0, none).otherwise(let(grams(w), select)))


def written(pairs: Column) -> Column:
    """A fingerprint as text: hash in hex, at, place; comma-joined."""
    one = lambda h, p: F.concat(F.hex(h), F.lit("@"), p.cast("string"))
    return F.array_join(F.zip_with(pairs["hash"], pairs["place"], one), ",")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard likeness of two hash arrays; 1 for two empty ones."""
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def _range_cuts(spark: SparkSession, docs: DataFrame) -> list[int]:
    """Cut points that split the ids into four ranges for each shuffle partition."""
    ranges = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", at, 100 * ranges).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below an id (a null id has none), by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.lit([int(c) for c in cuts]).cast("array<bigint>")
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    step = lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) <= doc_id, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next``: the struct of ``text`` and ``pairs`` of the row with the next doc_id, and of
    the first row for the last one.

    Rows are dealt by ranges of ids in one shuffle. Each range ends with the first row of the range
    after it, which a table of one row per range supplies. Null ids come first; rows that share an
    id follow each other by text.
    """
    spark = docs.sparkSession
    cuts = _range_cuts(spark, docs)
    ranged = docs.withColumn("range", _range_of(F.col("doc_id"), cuts))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "body.text")
    # Text and pairs travel once, as one column that the window also looks ahead to
    rows = ranged.select("doc_id", "range", F.struct("text", "pairs").alias("body"))
    rows = rows.withColumn("next", F.lead("body").over(order))
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    ids = stored(ranged.groupBy("range").agg(first.alias("doc_id")), "range-ids").alias("i")
    same = F.col("r.range").eqNullSafe(F.col("i.range")) & F.col("r.doc_id").eqNullSafe(F.col("i.doc_id"))
    # One id per range, and there are at most four ranges for each shuffle partition
    firsts = (
        ranged.alias("r").join(F.broadcast(ids), same, "left_semi").groupBy("range").agg(F.min("text").alias("text"))
    )
    around = Window.orderBy("range")
    head = F.coalesce(F.lead("text").over(around), F.first("text").over(around))
    heads = firsts.select("range", head.alias("text"))
    heads = stored(
        heads.select("range", F.struct("text", winnow(F.col("text")).alias("pairs")).alias("head")), "range-heads"
    )
    return rows.join(heads, "range", "left").select(
        "doc_id", "body.text", "body.pairs", F.coalesce("next", "head").alias("next")
    )


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text replaces the last quarter of the code points by the first ones of the next
    document. A null text counts as empty; a single document follows itself; extra columns are
    ignored; no rows give no result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts.withColumn("pairs", winnow(F.col("text"))))
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), size - quarter), F.substring(F.col("next.text"), F.lit(1), quarter)
    )
    rows = rows.withColumns({"n_chars": size.cast("long"), "edited": edited})
    rows = rows.withColumn("edited_pairs", winnow(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("pairs")).alias("fingerprint"),
        written(F.col("edited_pairs")).alias("edited_fingerprint"),
        likeness(F.col("pairs.hash"), F.col("edited_pairs.hash")).alias("near_edited"),
        likeness(F.col("pairs.hash"), F.col("next.pairs.hash")).alias("near_next"),
    )
