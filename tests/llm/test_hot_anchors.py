"""Passages that very many texts share in different surroundings."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sugarline.llm import repeats
from tests.llm.texts import unique_prose


def texts_around(rng, n):
    """A passage in n surroundings, in part with longer edges in common, and copies."""
    passage = unique_prose(rng, 9)
    edges = [unique_prose(rng, 4) for _ in range(5)]
    out = []
    for _ in range(n):
        left, right = (rng.choice([unique_prose(rng, 9), unique_prose(rng, 6) + rng.choice(edges)]) for _ in range(2))
        out.append(left + passage[rng.choice([0, 0, 3]) :] + right)
    return [*out, out[0], passage + passage, "ab" * 100, None, ""]


@pytest.mark.parametrize("shard_bytes", [400, 3000])
def test_split_anchors_equal_brute_force(spark, shard_bytes):
    texts = texts_around(random.Random(3), 90)
    size = 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.without_repeats(docs, size, 16, shard_bytes).collect()}
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    for doc_id, d in enumerate(data):
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        assert (got[doc_id].n_removed, bytes(got[doc_id].kept)) == (sum(gone), kept), doc_id


def test_a_passage_in_very_many_surroundings_stays_within_a_shard(spark, monkeypatch):
    """30,000 texts with one passage: no task sorts more than a shard of one anchor."""
    largest = []
    plain = repeats.sorted_windows

    def watched(parts, size, shard_bytes):
        by_anchor = parts.groupBy("anchor").agg(F.sum(F.octet_length("part")).alias("b")).agg(F.max("b").alias("b"))
        largest.append(by_anchor.first()["b"] or 0)
        return plain(parts, size, shard_bytes)

    monkeypatch.setattr(repeats, "sorted_windows", watched)
    rng = random.Random(7)
    passage = unique_prose(rng, 20)
    around = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.concat(
            F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("a"), "id"), 512), F.lit(passage),
            F.sha2(F.concat(F.lit("b"), "id"), 512), F.sha2(F.concat(F.lit("c"), "id"), 512),
        ).alias("text"),
    )
    rows = repeats.without_repeats(around).agg(F.sum("n_removed").alias("gone"), F.count("*").alias("n")).first()
    assert (rows.gone, rows.n) == (0, 30_000)
    assert max(largest) <= 1_000_000
