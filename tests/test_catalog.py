"""Registered queries against their DuckDB counterparts: a sample by default, all with HOSTWATCH_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from hostwatch import catalog
from conftest import SMALL
from oracle import compare, duck

SAMPLE = ("p14_private_ip", "p20_label_from_path", "w01_iat_with_ties", "w05_recent_flows", "a02_session_summary", "a15_host_profile", "a22_roc_auc",
          "a25_fpr_threshold", "d08_time_split", "d15_unseen", "f06_persistence", "x01_exact_quantiles", "c06_host_timelines")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("HOSTWATCH_ALL") else SAMPLE


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 100
    assert all(not n.startswith("op") and "pipeline" not in n for n in catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = compare(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert result.startswith("ok") and "types" not in result, result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"session_id", "n", "byte_volume_zscore"} <= set(df.columns)
