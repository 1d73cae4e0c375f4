"""Entries of JSON documents of any size, read in byte ranges by many tasks.

An object ends with ``}``, so a file is read in records that end there. What a record means depends
on what is open where its range (block) begins: a string, brackets, and the array that holds the
entries. The first is the parity of the quotes before, the second a sum, the third the last array
that was opened below the root; one summary row for each block carries them to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sugarline.sources import pieces

BLOCK = ["source", "block"]
#: An escaped character.
ESCAPE = r"(?s)\\."
#: Text up to and with a string, a bracket, or a colon.
PIECE = r'(?s)[^\[\]{}":]*+(?:"(?:[^"\\]|\\.)*+"|[\[\]{}:])'
#: An entry of more characters (over several records) is none: most likely its braces do not match.
ENTRY_LIMIT = 1 << 24


def read_records(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Records of the files whose names fit: source (path), written_at, block, file, size,
    pos, text."""
    files = spark.read.option("lineSep", "}").option("pathGlobFilter", pattern).text(path)
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("written_at"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("text"),
    )


def read_part_records(spark: SparkSession, path: str) -> DataFrame:
    """The same of documents that a job wrote in parts, ``file_name=<name>/part-<number>...``; a part
    ends between two entries."""
    files = spark.read.schema("value string, file_name string").option("lineSep", "}").text(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return files.select(
        F.col("file_name").alias("source"),
        F.col("_metadata.file_modification_time").alias("written_at"),
        (F.shiftleft(part, 36) + F.col("_metadata.file_block_start")).alias("block"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("text"),
    )


def read_piece_records(spark: SparkSession, path: str) -> DataFrame:
    """The same of documents that are kept in pieces (see ``pieces``)."""
    records = pieces.read_pieces(spark, path).select(
        F.col("file_name").alias("source"),
        "written_at",
        pieces.block().alias("block"),
        F.col("part").cast("string").alias("file"),
        F.octet_length("text").cast("bigint").alias("size"),
        # What follows the last brace is a record too, unless it is empty
        F.posexplode(F.split(F.regexp_replace("text", r"\}\z", ""), r"\}")).alias("pos", "text"),
    )
    return records.where("size > 0").withColumn("pos", F.col("pos").cast("bigint"))


def _brackets(text: Column) -> Column:
    """Brackets that are opened less those that are closed."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _outside(plain: Column) -> Column:
    """What of a text without escapes stands outside of strings, if it begins outside; the rest
    does, if it begins inside."""
    even = F.filter(F.split(plain, '"'), lambda _, i: i % 2 == 0)
    return F.when(plain.contains('"'), F.array_join(even, "")).otherwise(plain)


def _scan(text: Column, depth: Column, key: str) -> Column:
    """Struct of ``array`` (1: the array of ``key`` was opened last below the root, 0: it was closed
    or another one opened, null: neither) and ``begin`` (characters before the first object that
    begins in it, null if none does), for a record that begins outside of strings."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    state = F.struct(
        F.lit(0).alias("at"), depth.cast("bigint").alias("depth"), F.lit("").alias("name"),
        F.lit(None).cast("int").alias("array"), F.lit(None).cast("int").alias("begin"),
    )

    def step(s: Column, piece: Column) -> Column:
        last = F.right(piece, F.lit(1))
        below = s["depth"] == 1
        named = F.when(below & (last == '"'), F.regexp_extract(piece, '(?s)"(.*)"$', 1)).otherwise(s["name"])
        opens = F.when(last == "[", 1).otherwise(0)
        changed = below & last.isin("[", "{") | (s["depth"] == 2) & last.isin("]", "}")
        array = F.when(changed, F.when(below & (s["name"] == key), opens).otherwise(0)).otherwise(s["array"])
        starts = s["begin"].isNull() & (last == "{") & (s["depth"] == 2)
        return F.struct(
            (s["at"] + F.length(piece)).cast("int").alias("at"),
            (s["depth"] + F.when(last.isin("[", "{"), 1).when(last.isin("]", "}"), -1).otherwise(0)).alias("depth"),
            named.alias("name"),
            array.cast("int").alias("array"),
            F.when(starts, s["at"] + F.length(piece) - 1).otherwise(s["begin"]).cast("int").alias("begin"),
        )

    return F.aggregate(pieces, state, step)


def entries(records: DataFrame, key: str = "sgs") -> DataFrame:
    """source, written_at, pos (ascending through the document) and entry (text of an object) of all
    objects in the array ``key`` of the root object. Records that are no objects have none.

    A document whose strings and brackets are not all closed gives none.
    """
    in_block = Window.partitionBy(*BLOCK).orderBy("pos")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    plain = F.when(text.contains("\\"), F.regexp_replace(text, ESCAPE, "")).otherwise(text)
    quotes = F.length(plain) - F.length(F.translate(plain, '"', ""))
    # What a text says by itself is counted once, before the branches below
    lines = records.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("block", F.lit(0)).alias("block"),
        "written_at",
        "file",
        "size",
        "pos",
        text.alias("text"),
        (F.octet_length(text) + 1).alias("bytes"),
        (quotes % 2).alias("odd"),
        _brackets(plain).alias("all"),
        _brackets(_outside(plain)).alias("even"),
    ).repartition(*BLOCK)
    lines = lines.withColumn("before", F.sum("odd").over(so_far) - F.col("odd"))
    for name, flip in (("shut", 0), ("open", 1)):
        inside = (F.col("before") + flip) % 2 == 1
        delta = F.when(inside, F.col("all") - F.col("even")).otherwise(F.col("even"))
        ends = (F.col("before") + F.col("odd") + flip) % 2 == 0
        lines = lines.withColumn(name, delta - F.when(ends, 1).otherwise(0))
    summary = lines.groupBy(*BLOCK).agg(
        F.sum("odd").alias("odd"),
        F.sum("shut").alias("shut"),
        F.sum("open").alias("open"),
        F.max("file").alias("file"),
        F.max("size").alias("size"),
        F.sum("bytes").alias("bytes"),
    )
    blocks = Window.partitionBy("source").orderBy("block")
    earlier, whole = blocks.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    summary = summary.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    # What follows a file's last brace is a record too, but no brace ended it: a byte is missing
    of_file = Window.partitionBy("source", "file")
    endless = (F.sum("bytes").over(of_file) == F.col("size") + 1) & (F.col("block") == F.max("block").over(of_file))
    in_string = (F.col("inside").cast("int") + F.col("odd")) % 2 == 1
    depth = F.when(F.col("inside"), F.col("open")).otherwise(F.col("shut"))
    summary = summary.withColumn("depth", depth + F.when(endless & ~in_string, 1).otherwise(0))
    carried = summary.select(
        *BLOCK,
        "inside",
        F.coalesce(F.sum("depth").over(earlier), F.lit(0)).alias("base"),
        F.sum("depth").over(whole).alias("left"),
        (F.sum("odd").over(whole) % 2).alias("unclosed"),
    )
    sound = carried.where("left = 0 AND unclosed = 0")
    lines = lines.join(sound, BLOCK).select(
        *BLOCK,
        "written_at",
        "pos",
        "text",
        ((F.col("before") + F.col("inside").cast("int")) % 2 == 1).alias("inside"),
        F.when(F.col("inside"), F.col("open")).otherwise(F.col("shut")).alias("delta"),
        "base",
    )
    lines = lines.withColumn("depth", F.col("base") + F.sum("delta").over(so_far) - F.col("delta"))
    # Where a plain entry follows another, and inside of one, there is nothing to search
    special = F.col("inside") | F.col("text").rlike(r"[\[\]]")
    simple = (F.col("depth") == 2) & ~special
    text = F.when(F.col("inside"), F.concat(F.lit('"'), "text")).otherwise(F.col("text"))
    scanned = F.when((F.col("depth") < 2) | special, _scan(text, F.col("depth"), key))
    lines = lines.withColumn("s", scanned)
    begin = F.when(simple, F.nullif(F.instr("text", "{"), F.lit(0)) - 1)
    begin = F.coalesce(begin, F.col("s.begin") - F.col("inside").cast("int"))
    lines = lines.select(
        *BLOCK, "written_at", "pos", "text", "depth", "delta", F.col("s.array").alias("array"), begin.cast("int").alias("begin")
    )
    # An entry ends where the depth is back at 2; until then every record belongs to it
    event = F.when(F.col("depth") + F.col("delta") == 2, 0).when(F.col("begin").isNotNull(), 1)
    arrays = lines.groupBy(*BLOCK).agg(
        F.max_by("array", F.when(F.col("array").isNotNull(), F.col("pos"))).alias("array"),
        F.max(F.when(F.col("begin").isNotNull(), F.struct(F.col("block").alias("b"), F.col("pos").alias("p")))).alias("start"),
        F.max_by(event, F.when(event.isNotNull(), F.col("pos"))).alias("event"),
        F.count("text").alias("_n"),
    )
    arrays = arrays.select(
        *BLOCK,
        F.last("array", ignorenulls=True).over(earlier).alias("array_before"),
        F.last("start", ignorenulls=True).over(earlier).alias("start_before"),
        F.last("event", ignorenulls=True).over(earlier).alias("event_before"),
    )
    start = F.when(F.col("begin").isNotNull(), F.struct(F.col("block").alias("b"), F.col("pos").alias("p")))
    lines = lines.select(
        *BLOCK,
        "written_at",
        "pos",
        "text",
        "depth",
        "delta",
        "begin",
        F.last("array", ignorenulls=True).over(so_far).alias("array"),
        F.last(start, ignorenulls=True).over(so_far).alias("start"),
        F.last(event, ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1)).alias("event"),
        (F.col("block") + F.row_number().over(in_block)).alias("row"),
    ).join(arrays, BLOCK, "left")
    lines = lines.where(F.coalesce("array", "array_before", F.lit(0)) == 1)
    lines = lines.where((F.coalesce("event", "event_before") == 1) | F.col("begin").isNotNull())
    lines = lines.withColumns(
        {
            "start": F.coalesce("start", "start_before"),
            "text": F.concat(F.when(F.col("begin").isNull(), F.col("text")).otherwise(F.expr("substr(text, begin + 1)")), F.lit("}")),
            "alone": F.col("begin").isNotNull() & (F.col("depth") + F.col("delta") == 2),
        }
    )
    one = lines.where("alone").select("source", "written_at", F.col("row").alias("pos"), F.col("text").alias("entry"))
    piece = F.when(F.length("text") <= ENTRY_LIMIT, F.struct("block", "pos", "text"))
    several = (
        lines.where("NOT alone")
        .groupBy("source", "start")
        .agg(
            F.max("written_at").alias("written_at"),
            F.min("row").alias("pos"),
            F.sum(F.length("text")).alias("chars"),
            F.sort_array(F.collect_list(piece)).alias("parts"),
        )
        .where(F.col("chars") <= ENTRY_LIMIT)
        .select("source", "written_at", "pos", F.array_join("parts.text", "").alias("entry"))
    )
    return one.unionByName(several)
