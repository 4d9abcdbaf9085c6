"""Physical-plan properties that the scale design relies on (static plans)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabwatch.plans import ordered as O

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n != "g5_stream_monitor"))
def test_no_cartesian_or_nested_loop_join(static, name):
    plan = _plan(E.queries()[name](static, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_last_n_is_partial_top_k(static):
    plan = _plan(E.queries()["g1_last_n"](static, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_order_windows_are_bucketed(static):
    df = static.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    plan = _plan(O.running_sum(df, ["k"], ["v"], ["v"]))
    windows = [ln for ln in plan.splitlines() if "Window [" in ln and "_rb_cell" not in ln]
    data_windows = [w for w in windows if "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" in w.upper()
                    or "currentrow" in w.lower()]
    assert data_windows and all("_bucket" in w for w in data_windows)


def test_scan_prunes_and_pushes(static):
    plan = _plan(E.queries()["e12_numeric_psi_alerts"](static, SF))
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem.parquet" in ln]
    assert scans
    for s in scans:
        assert "l_shipdate" in s and "PushedFilters: [IsNotNull(l_shipdate)" in s
        read = s[s.index("ReadSchema"):]
        assert "l_orderkey" not in read and "l_returnflag" not in read
