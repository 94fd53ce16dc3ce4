"""Physical plans: push-down, number of scans, no nested loops."""

import re

import pytest

from ledgerlight import plans
from ledgerlight.operators import budgets, costs
from ledgerlight.sources import sample
from ledgerlight.sources.sample import AS_OF

QUERIES = plans.queries()
STREAMS = [n for n in QUERIES if n.startswith("stream_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return len(re.findall(rf"FileScan parquet .*?{table}\.parquet", text))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_no_cartesian_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text
    assert "SinglePartition" not in text or name in SINGLE


# Global counts: one partial row per task meets in one task.
SINGLE = {"key_violations"}


def test_window_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["cost_summary"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    schema = re.search(r"ReadSchema: struct<(.*?l_shipdate.*?)>", text).group(1)
    assert "l_linestatus" not in schema
    customer = re.search(r"ReadSchema: struct<(c_custkey.*?)>", text).group(1)
    assert customer == "c_custkey:bigint,c_mktsegment:string"


def test_tenant_reaches_the_scan(spark, sf_dir):
    df = costs.daily_costs(sample.cost_records(spark, sf_dir), AS_OF, tenant_id="BUILDING")
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(df)


@pytest.mark.parametrize("name", ["cost_summary", "monitoring_facets", "spend_spikes", "baseline_stats", "forecast_linear", "period_over_period", "service_churn"])
def test_one_scan(spark, sf_dir, name):
    assert scans(plan(QUERIES[name](spark, sf_dir)), "lineitem") == 1


def test_rollup_is_a_hash_aggregation_in_codegen(spark, sf_dir):
    df = QUERIES["usage_to_cost_rollup"](spark, sf_dir)
    df.collect()
    text = plan(df)
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert re.search(r"\*\(\d+\) HashAggregate", text)


def test_anomaly_detectors_share_the_fact(spark, sf_dir):
    df = QUERIES["anomaly_events"](spark, sf_dir)
    # One planned scan: stricter than a second one that would be replaced by a reused exchange.
    assert scans(plan(df), "lineitem") == 1
    df.collect()
    assert scans(plan(df).split("== Initial Plan ==")[0], "lineitem") == 1


def test_budget_match_is_an_equi_join(spark, sf_dir):
    fact, accounts = sample.cost_records(spark, sf_dir), sample.accounts(spark, sf_dir)
    b = sample.budgets(spark, sf_dir, fact)
    for scope in ("tenant", "account"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan(budgets.budget_status(fact, b, AS_OF, scope, accounts))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # Without any broadcast the match is still a join on keys.
        assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text


def test_top_n_is_cut_before_the_exchange(spark, sf_dir):
    fact = sample.cost_records(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan(costs.top_services(fact, AS_OF, tenant_id="BUILDING"))
    assert "WindowGroupLimit" in plan(costs.top_n_per_account(fact, AS_OF))
