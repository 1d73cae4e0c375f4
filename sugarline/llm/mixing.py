"""Mix sources to target weights by nested hash thresholds; DataFrame functions only.

Every document gets a hash. Of each source, the documents below a hash threshold are taken. The
threshold comes from histograms: tokens are summed by source and hash bucket, the bucket in which
the budget ends is split into finer buckets, and so on until that bucket holds one hash value.
Nothing is sorted but the at most 1,024 buckets of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sugarline.llm.common import native_words, stored

#: The hash is the first 15 hex digits of an md5: 60 bits, read 10 bits a level.
HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.size(native_words(text)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: ``source_size`` and ``target`` tokens.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all
    tokens by weight. No target exceeds ``most`` times its source; what is left over is shared
    again by weight. That fixed point needs no loop: sources fill up in the order of limit per
    weight, so the ones that stay full are the first ones of that order. A source is one row here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    limited = totals.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = limited.withColumn("level", level)
    # The first source that does not fill up sets the level of itself and of all after it
    open_level = F.min(
        F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))
    ).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(open_level * F.col("weight"), F.col("limit")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def cut_points(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the hash at which its budget ``rest`` ends: source, edge, below (tokens of
    smaller hashes), at (tokens of that hash)."""
    opened = budgets.select(
        "source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "rest"
    )
    edges = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        here, there = sizes.alias("here"), opened.alias("there")
        inside = here.join(
            there,
            F.col("here.source").eqNullSafe(F.col("there.source"))
            & (F.shiftright("here.hash", shift + LEVEL_BITS) == F.col("there.prefix")),
        )
        counted = inside.groupBy(
            F.col("there.source").alias("source"), "below", "rest", F.shiftright("hash", shift).alias("prefix")
        ).agg(F.sum("size").alias("at"), F.min("hash").alias("edge"), F.max("hash").alias("last"))
        until = F.col("below") + F.sum("at").over(Window.partitionBy("source").orderBy("prefix"))
        crossed = (
            counted.withColumn("until", until)
            .where((F.col("until") > F.col("rest")) & (F.col("until") - F.col("at") <= F.col("rest")))
            .withColumn("below", F.col("until") - F.col("at"))
            .drop("until")
        )
        crossed = stored(crossed, "mix-level")
        single = F.col("edge") == F.col("last")
        found = crossed.where(single).select("source", "edge", "below", "at")
        edges = found if edges is None else edges.unionByName(found)
        opened = crossed.where(~single).select("source", "prefix", "below", "rest")
        if opened.isEmpty():
            break
    return edges


def with_size(docs: DataFrame) -> DataFrame:
    """Adds ``size`` (words) and ``hash`` (60 bits of the md5 of doc_id, a null one as empty)."""
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15)
    return docs.withColumns({"size": word_count(F.col("text")), "hash": F.conv(digest, 16, 10).cast("long")})


def plan_mix(sizes: DataFrame, **options) -> DataFrame:
    """One row per source with its target, whole copies of all its documents, and cut point.

    ``sizes`` has source, size and hash; options are those of :func:`source_targets`.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = (
        source_targets(sizes, **options)
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    targets = stored(targets, "mix-targets")
    edges = cut_points(sizes, targets)
    return stored(
        targets.alias("t")
        .join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
        .select("t.*", "edge", "below", "at"),
        "mix-plan",
    )


def take(sized: DataFrame, plan: DataFrame, whole_documents: bool = False) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` (words) to rows with source, size and hash.

    The document at the cut point is taken in part, so that a source meets its target to the word;
    repeated ids share one hash and split what is left in proportion. With ``whole_documents`` that
    document is taken whole if at least half of it is wanted, else not at all.
    """
    rest = F.col("m.rest") - F.col("m.below")
    part = F.floor(rest / F.col("m.at") * F.col("d.size")).cast("long")
    if whole_documents:
        part = F.when(2 * rest >= F.col("m.at"), F.col("d.size")).otherwise(0)
    extra = F.when(F.col("d.hash") < F.col("m.edge"), F.col("d.size")).when(
        F.col("d.hash") == F.col("m.edge"), part
    )
    taken = F.col("m.whole") * F.col("d.size") + F.coalesce(extra, F.lit(0))
    return (
        sized.alias("d")
        .join(plan.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")))
        .select("d.*", "m.source_size", "m.target", taken.cast("long").alias("taken"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    Null texts and texts without words have size 0 and nothing is taken of them. A null source is
    a source of its own, the last one. Repeated rows are documents of their own. No rows, no result.
    """
    sizes = stored(with_size(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    return take(sizes, plan_mix(sizes, **options)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as they are taken, with all their columns.

    Only whole documents are taken. Columns of ``docs`` that have the names used here are kept.
    """
    packed = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*docs.columns).alias("row"))
    sized = with_size(packed).drop("text")
    plan = plan_mix(stored(sized.select("source", "size", "hash"), "mix-sizes"), **options)
    chosen = take(sized, plan, whole_documents=True)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return (
        chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
        .where("copy > 0")
        .select("row.*")
    )
