"""Registered queries against their SQL on the smallest tables.

A choice by default; all of them with ALL_QUERIES=1, or with ``python -m tests.oracle_check``.
"""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_check import connect, difference

CHOICE = (
    "build_feature_frame",
    "rolling_sum_12",
    "glycemic_statistics_lineitem",
    "client_statistics",
    "glucose_histogram",
    "correlation_matrix",
    "dataset_profile",
    "read_cgm_csv",
    "carry_header",
    "read_cgm_json",
    "read_event_xml",
    "latest_readings",
    "stream_latest_view",
)
NAMES = tuple(n for n in queries() if n in oracle_sql()) if os.environ.get("ALL_QUERIES") else CHOICE

needs_data = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    got = queries()[name](spark, SF_SMALL).toPandas()
    want = connect(SF_SMALL).execute(oracle_sql()[name]).df()
    assert difference(got, want) is None
    assert len(got) > 0


@needs_data
def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[0] == "ts" and frame.count() > 0


def test_every_query_has_sql():
    """Those of the training-data operators may have none (see their own tests)."""
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(oracle_sql()) <= set(queries())
