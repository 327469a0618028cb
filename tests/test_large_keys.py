"""Queries whose container numbers outgrow their seven digits: the small tables with keys beyond 1.25 million, where a bill's numbers coincide."""

import os

import pytest
from pyspark.sql import functions as F

from docrec.plans.registry import ORACLES, QUERIES
from tests.oracle import check

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


@pytest.fixture(scope="module")
def shifted(spark, small, tmp_path_factory):
    out = tmp_path_factory.mktemp("large_keys")
    for f in os.listdir(small):
        name = f.split(".")[0]
        if name in KEYS:
            spark.read.parquet(f"{small}/{f}").withColumn(KEYS[name], F.col(KEYS[name]) + 3_000_000).toPandas().to_parquet(out / f, coerce_timestamps="us")
        else:
            os.symlink(f"{small}/{f}", out / f)
    return str(out)


@pytest.mark.parametrize("name", ["agg1_group_by_bl", "det6_weight_scope_vote", "det9_fingerprint", "row1_containers_in_block", "row2_emit_rows"])
def test_query_equals_its_oracle_with_large_keys(spark, shifted, name):
    check(QUERIES[name](spark, shifted), ORACLES[name], shifted)
