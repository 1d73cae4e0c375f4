"""The registered queries against their SQL, and the pipeline against its parts."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from sugarline.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    assert difference(got, connect(SF_SMALL).execute(ORACLE[name]).df(), exact=False) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_the_table(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, SF_SMALL).select("doc_id").collect()} == ids


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against plain versions of its decisions."""
    import corpus_pipeline
    from sugarline.llm.common import stored
    from tests.llm.test_operators import groups_by_brute_force

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        rows[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    accepted = [(r.doc_id, r.text) for r in rows["quality"]]
    group, _ = groups_by_brute_force(accepted)
    least = defaultdict(list)
    for (doc_id, _), g in zip(accepted, group, strict=True):
        least[g].append(doc_id)
    kept = {r.doc_id for r in rows["near_duplicates"]}
    assert kept == {min(v) for v in least.values()}
    assert {r.doc_id for r in rows["secrets"]} == kept
    assert all(r.n_chars == len(r.text) for r in rows["secrets"])
    copies = Counter(r.doc_id for r in rows["mixing"])
    assert set(copies) <= kept and max(copies.values()) <= 2
    starts = Counter(r.doc_id for r in rows["packing"] if r.start == 0)
    assert starts == copies
