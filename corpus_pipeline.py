"""From raw documents to packed training sequences, in stages that each write a table.

1. quality: documents that the quality model scores below one half go.
2. near_duplicates: one document of each group of near duplicates stays, the one with the smallest id.
3. secrets: secrets are masked in the texts; no document goes.
4. mixing: documents are taken, left out or repeated until the sources have their target weights.
5. packing: token ids are packed into sequences.

Null and empty texts are scored like others; where they are kept they have no near duplicates and no
secrets, count 0 words in the mixture and pack as the end token alone. Of rows that repeat a doc_id
one stays after the second stage. Equal doc_ids and texts give equal decisions; no documents give no
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarline.llm import mixing, near_duplicates, packing, quality_model, secrets
from sugarline.llm.common import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.accepted(docs, labels)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.withColumn("text", secrets.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixture),
    ("packing", sequences),
]

#: The model, the word tokenizer and the compression are beyond SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
