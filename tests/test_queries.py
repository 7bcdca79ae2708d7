"""Registered queries against their SQL, and the shape of their plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
import check
from seatwise.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) is None


STREAMED = {n for n in QUERIES if n.startswith("stream_")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_nested_loop_joins(spark, name):
    plan = registered.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = registered.queries()["sales_by_day"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan


def plan_of(spark, name, **conf):
    """Physical plan without adaptive execution, so that reuse is visible in it."""
    conf = {"spark.sql.adaptive.enabled": "false", **conf}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return registered.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_overlap_sums_share_their_shuffles(spark):
    plan = plan_of(spark, "overlap_sum_all", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert plan.count("ReusedExchange") >= 2


def test_top_k_does_not_sort_everything(spark):
    plan = plan_of(spark, "top_dishes")
    assert plan.startswith("TakeOrderedAndProject") and "rangepartitioning" not in plan


def test_large_sides_are_not_broadcast(spark):
    """With the size threshold at zero only the per-task counts of new ids are broadcast."""
    for name in ("check_slots", "daily_kpis", "order_detail", "table_availability", "refused_deletes"):
        plan = plan_of(spark, name, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert all("[_task#" in line for line in joins), name


def scans(spark, name):
    plan = plan_of(spark, name, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    return plan, plan.count("FileScan parquet")


def test_status_reaches_the_scan(spark):
    for name, flag in (("sales_by_day", "R"), ("ready_lines", "N"), ("delivered_lines", "R"), ("kitchen_load", "A")):
        assert f"EqualTo(l_returnflag,{flag})" in plan_of(spark, name), name


def test_lines_are_read_once(spark):
    for name in ("daily_kpis", "sales_by_month", "order_totals", "dish_ranking"):
        assert plan_of(spark, name).count("ReadSchema: struct<l_") == 1, name


def test_audits_read_each_table_once_per_part(spark):
    plan, n = scans(spark, "audit_fks")
    assert n <= 16 and plan.count("Exchange hashpartitioning") <= 12
    assert scans(spark, "audit_uniques")[1] <= 12


def test_slot_checks_read_what_was_written_once(spark):
    for name in ("check_slots", "recheck_slots"):
        assert scans(spark, name)[1] <= 1, name


def test_no_bucket_totals_in_one_task(spark):
    """Without keys only the totals of 38-hour runs, already folded, meet in one window."""
    plan = plan_of(spark, "overlap_sum_all")
    assert plan.count("Exchange SinglePartition") > 0
    for line in plan.splitlines():
        if "Window" in line and "windowspecdefinition(0" in line:
            assert "_run" in line


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["day", "total_sales"] and df.count() > 0


def test_first_lines_are_cut_before_the_shuffle(spark):
    plan = plan_of(spark, "kitchen_first", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    # Per dish and per cook: a cut to k rows within each task, and one after the shuffle.
    assert plan.count("WindowGroupLimit") == 4


def test_ranges_of_any_length_meet_by_cells(spark):
    plan = plan_of(spark, "overlap_pairs", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    assert "hashpartitioning(place" in plan and "_cell" in plan and "NestedLoop" not in plan


def test_cooks_meet_ranks_of_dishes_not_lines(spark):
    """What is sorted per cook before the shuffle are ranks: no line of a dish comes in before the cook's dishes are cut."""
    plan = plan_of(spark, "kitchen_first", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    cut = next(line for line in reversed(plan.splitlines()) if "WindowGroupLimit" in line)
    assert "_rank" in cut and "requested" not in cut


def test_points_without_long_ranges_are_marked_once(spark):
    """Points take the wider levels only by a join with the keys of long ranges."""
    plan = plan_of(spark, "overlap_pairs", **{"spark.sql.autoBroadcastJoinThreshold": "-1"})
    marks = [line for line in plan.splitlines() if "Generate explode(sequence" in line]
    assert marks and all("explode(sequence(1, _top" in line for line in marks)
