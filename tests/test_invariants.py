"""Totals that must agree, and hot keys against brute force."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlight.operators import budgets, costs, ranks, rollups, rootcause
from ledgerlight.sinks import shared_dir, write_cost_table
from ledgerlight.sources import sample, tables
from ledgerlight.sources.sample import AS_OF


@pytest.fixture(scope="module")
def fact(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "cost_records")
    write_cost_table(sample.cost_records(spark, sf_dir), path)
    return spark.read.parquet(path)


def test_facets_add_up(fact):
    sums = {(r.tenant_id, r.facet): r.s for r in costs.monitoring_facets(fact, AS_OF).groupBy("tenant_id", "facet").agg(F.sum("total").alias("s")).collect()}
    for tenant in {t for t, _ in sums}:
        assert len({sums[(tenant, f)] for f in ("service", "region", "date", "total")}) == 1


def test_rollup_adds_up(fact):
    levels = {r.level: r.s for r in rollups.multi_account_rollup(fact).groupBy("level").agg(F.sum("total_usd").alias("s")).collect()}
    assert set(levels) == {0, 1, 2, 3} and len(set(levels.values())) == 1


def test_one_tenant_equals_its_part_of_all(fact):
    for op in (costs.cost_summary, costs.daily_costs, costs.top_services, costs.costs_by_region, costs.cost_data_total, costs.monitoring_facets):
        everyone = op(fact, AS_OF)
        one = op(fact, AS_OF, tenant_id="BUILDING")
        part = everyone.where("tenant_id = 'BUILDING'")
        assert one.count() == part.count() and one.exceptAll(part).count() == 0, op.__name__


def test_accounts_of_a_tenant_add_up(fact):
    accounts = [r.aws_account_id for r in fact.where("tenant_id = 'BUILDING'").select("aws_account_id").distinct().collect()]
    whole = costs.cost_data_total(fact, AS_OF, tenant_id="BUILDING").first().total
    parts = [costs.cost_data_total(fact, AS_OF, tenant_id="BUILDING", aws_account_id=a).first().total for a in accounts]
    assert sum(parts) == whole
    assert costs.cost_summary(fact, AS_OF, tenant_id="BUILDING", aws_account_id="none").count() == 0


def test_views_can_be_queried(spark, fact):
    costs.register_views(fact, AS_OF)
    sums = [spark.sql(f"SELECT sum(total_usd) FROM {v}").first()[0] for v in ("v_monthly_spend", "v_daily_spend")]
    assert sums[0] == sums[1] == fact.agg(F.sum("cost_usd")).first()[0]


def test_large_limits_are_exact(spark):
    rows = [("hot" if i % 3 else f"t{i % 5}", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "tenant_id string, v int")
    got = tables.top_n(df, 2000, [F.col("v").desc()])
    brute = df.withColumn("r", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.col("v").desc()))).where("r <= 2000").drop("r")
    assert got.count() == brute.count() and got.exceptAll(brute).count() == 0


def test_contribution_shares_add_up(fact):
    sums = rootcause.rca_contribution(fact, AS_OF).where("share_pct IS NOT NULL").groupBy("aws_account_id").agg(F.sum("share_pct").alias("s"))
    assert all(abs(r.s - 100) < 0.01 for r in sums.collect())


def test_joint_split_is_the_smallest_of_all_subsets(fact):
    """Every subset of the slices of every grouping, for accounts of few slices."""
    got = {}
    for r in rootcause.rca_joint_split(fact, AS_OF, most=None).collect():
        got.setdefault((r.tenant_id, r.aws_account_id), []).append(r)
    slices = {}
    for r in rootcause.rca_contribution(fact, AS_OF).collect():
        slices.setdefault((r.tenant_id, r.aws_account_id), []).append(r)
    checked = 0
    for account, parts in slices.items():
        total = sum(p.delta_usd for p in parts)
        best = None
        for grouping in (("service",), ("region",), ("service", "region")):
            cells = {}
            for p in parts:
                key = tuple(p[c] for c in grouping)
                cells[key] = cells.get(key, 0) + p.delta_usd
            if len(cells) > 12:
                break
            for n in range(1, len(cells) + 1):
                if any(abs(sum(c)) * 100 >= abs(total) * 80 and sum(c) * total > 0 for c in itertools.combinations(cells.values(), n)):
                    best = min(best or n, n)
                    break
        else:
            if best is None:
                assert account not in got
                continue
            mine = got[account]
            assert len(mine) == best == mine[0].slices
            assert abs(sum(r.share_pct for r in mine) - mine[0].explained_pct) < 0.01 and mine[0].explained_pct >= 80
            checked += 1
    assert checked > 5


def test_fact_table_is_partitioned_by_month(fact):
    plan = fact.where("month = DATE'2001-09-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_ranks_of_a_hot_group(spark):
    """A third of the rows in one tenant, many ties, values across bucket borders."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"t{i % 7}", Decimal(rnd.choice([1, 9999, 10000, 123456, 99999999])) / 100 + rnd.randrange(50)) for i in range(3000)]
    rows += [("lonely", Decimal("5.00")), ("none", None)]
    df = spark.createDataFrame(rows, "tenant_id string, v decimal(24,2)")
    known = df.where("v IS NOT NULL")
    w = Window.partitionBy("tenant_id").orderBy("v")
    brute = known.select("tenant_id", "v", (F.rank().over(w) - 1).alias("below"), F.count("*").over(Window.partitionBy("tenant_id")).alias("n")).distinct()
    got = ranks.value_ranks(df, ["tenant_id"], "v", bucket_cents=1000)
    assert got.count() == brute.count() and got.exceptAll(brute).count() == 0
    cut = ranks.rank_thresholds(df, ["tenant_id"], "v", {"half": 0.5}, bucket_cents=1000)
    kept = known.join(cut, "tenant_id").where("v >= half").count()
    assert kept == known.withColumn("p", F.percent_rank().over(w)).where("p >= 0.5").count() + 0


def test_change_ranks_of_a_hot_account(spark):
    start = dt.datetime(2026, 6, 2, 14)
    rnd = random.Random(3)
    changes = [(i, "hot" if i % 3 else f"a{i % 5}", "r", "created", start + dt.timedelta(seconds=rnd.randrange(-7200, 90000))) for i in range(2000)]
    df = spark.createDataFrame(changes, "change_id int, aws_account_id string, resource_id string, action string, changed_at timestamp_ntz")
    anomalies = spark.createDataFrame([(a, a, start, start + dt.timedelta(hours=24)) for a in ("hot", "a0", "a1", "quiet")], "anomaly_id string, aws_account_id string, start_at timestamp_ntz, end_at timestamp_ntz")
    got = {(r.anomaly_id, r.change_id): (r.lag_minutes, r.closeness_rank) for r in rootcause.rca_change_correlation(anomalies, df).collect()}
    pairs = {}
    for a in ("hot", "a0", "a1"):
        for c, acct, _, _, at in changes:
            if acct == a and start - dt.timedelta(minutes=60) <= at <= start + dt.timedelta(hours=24):
                pairs[(a, c)] = int((start - at).total_seconds() // 60)
    assert {k: v[0] for k, v in got.items()} == pairs
    for (a, c), (lag, rank) in got.items():
        assert rank == 1 + sum(1 for (b, _), other in pairs.items() if b == a and abs(other) < abs(lag))


def test_budget_cells_equal_the_theta_join(spark, fact):
    """The cell match gives what the three IS NULL OR = tests give."""
    rnd = random.Random(5)
    pick = lambda values: rnd.choice([None, *values])
    accounts = [r.aws_account_id for r in fact.select("aws_account_id").distinct().collect()]
    rows = [(f"b{i}", rnd.choice(sample.TENANTS), pick(accounts), pick(["compute", "storage", "other"]), pick(["us-east-1", "global"])) for i in range(200)]
    b = spark.createDataFrame(rows, "id string, tenant_id string, aws_account_id string, service_group string, region string")
    got = {r.id: r.current_usd for r in budgets.match_budgets(budgets.month_to_date_slices(fact, AS_OF), b, ["current_usd"]).collect()}
    spend = budgets.month_to_date_slices(fact, AS_OF).collect()
    for i, t, a, g, r in rows:
        expected = sum(s.current_usd for s in spend if s.tenant_id == t and a in (None, s.aws_account_id) and g in (None, s.service_group) and r in (None, s.region))
        assert got[i] == expected


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, setting):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: setting)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-{setting}"})


def test_shared_dir():
    assert shared_dir(Session("spark://x", "/shared/dir/")) == "/shared/dir"
    assert shared_dir(Session("local[2]", None)) == shared_dir(Session("local", None))
    for master in ("spark://x", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(Session(master, None))
