"""Exact semantics on tiny literal inputs."""

import datetime as dt
import hashlib
import json
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import (
    as_date, fenced_json, month_end, months_back, normalise_region, pct_change, pct_of_limit, record_id,
    service_group, severity_for_pct, sorted_json, validate_days, SERVICE_GROUPS,
)
from ledgerlight.operators import agents, alerts, anomaly, budgets, costs, forecast, inventory, jobs, quality, rollups, tags, trends
from ledgerlight.schemas import COST_RECORDS
from ledgerlight.sinks import alert_dedup_append, json_export, recommendations_table, upsert_cost_records
from ledgerlight.sources import feed, tables

D = dt.date
AS_OF = D(2026, 6, 15)


def records(spark, rows):
    """Cost records from (tenant, account, date, service, region, cost) with defaults."""
    schema = "tenant_id string, aws_account_id string, date date, service string, region string, cost_usd decimal(18,6)"
    df = spark.createDataFrame([(*r[:5], Dec(str(r[5]))) for r in rows], schema)
    return df.select(
        "*",
        F.lit("DAILY").alias("granularity"),
        service_group("service").alias("service_group"),
        F.col("aws_account_id").alias("account_alias"),
        F.lit(1).cast("decimal(18,4)").alias("usage_quantity"),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- names, ids, amounts


# What each service name has to give, written out.
EXPECTED_GROUPS = [
    ("Amazon EC2", "compute"), ("EC2 - Other", "compute"), ("AWS Lambda", "compute"), ("Amazon ECS", "compute"),
    ("Amazon EKS", "compute"), ("AWS Fargate", "compute"), ("Amazon Lightsail", "compute"), ("AWS Batch", "compute"),
    ("Amazon S3", "storage"), ("Amazon Simple Storage Service", "storage"), ("Amazon EBS", "storage"),
    ("Amazon Elastic Block Store", "storage"), ("Amazon EFS", "storage"), ("Amazon S3 Glacier", "storage"),
    ("Amazon FSx", "storage"), ("AWS Storage Gateway", "storage"), ("Amazon RDS", "database"),
    ("Amazon Relational Database Service", "database"), ("Amazon DynamoDB", "database"),
    ("Amazon ElastiCache", "database"), ("Amazon Redshift", "database"), ("Amazon Aurora", "database"),
    ("Amazon DocumentDB", "database"), ("Amazon Neptune", "database"), ("Amazon MemoryDB", "database"),
    ("Amazon CloudFront", "network"), ("Amazon Route 53", "network"), ("Amazon VPC", "network"),
    ("Amazon API Gateway", "network"), ("AWS Transit Gateway", "network"), ("Amazon Global Accelerator", "network"),
    ("AWS Direct Connect", "network"), ("AWS PrivateLink", "network"), ("Amazon SageMaker", "ai_ml"),
    ("Amazon Bedrock", "ai_ml"), ("Amazon Rekognition", "ai_ml"), ("Amazon Comprehend", "ai_ml"),
    ("Amazon Textract", "ai_ml"), ("Amazon Polly", "ai_ml"), ("Amazon Translate", "ai_ml"),
    ("Amazon Athena", "analytics"), ("Amazon EMR", "analytics"), ("Amazon Kinesis", "analytics"),
    ("AWS Glue", "analytics"), ("Amazon QuickSight", "analytics"), ("Amazon CloudWatch", "management"),
    ("AWS CloudTrail", "management"), ("AWS Config", "management"), ("AWS Systems Manager", "management"),
    ("AWS CloudFormation", "management"), ("AWS CodeBuild", "management"), ("AWS CodePipeline", "management"),
]


def test_all_exact_names(spark):
    assert len(EXPECTED_GROUPS) == 52
    assert sorted(EXPECTED_GROUPS) == sorted((n, g) for g, names in SERVICE_GROUPS.items() for n in names)
    df = spark.createDataFrame(EXPECTED_GROUPS, "service string, expected string")
    assert df.where(service_group("service") != F.col("expected")).count() == 0


@pytest.mark.parametrize(
    "name, group",
    [
        ("Amazon Elastic Container Service", "ai_ml"),  # contains "ai"
        ("Amazon Elastic File System", "other"),
        ("Amazon Virtual Private Cloud", "other"),
        ("AmazonCloudWatch", "other"),
        ("Amazon Elastic Compute Cloud - Compute", "compute"),
        ("amazon athena", "other"),  # exact names are case-sensitive, analytics has no fragments
        ("AMAZON EC2", "compute"),  # fragments are not
        ("Some Storage and Network Thing", "storage"),  # first rule wins
        (None, "other"),
    ],
)
def test_fragment_rules(spark, name, group):
    df = spark.createDataFrame([(name,)], "service string")
    assert df.select(service_group("service")).first()[0] == group


def test_record_id_uses_raw_region_and_keeps_null(spark):
    df = spark.createDataFrame(
        [("1", D(2026, 6, 1), "S", "NoRegion"), ("1", D(2026, 6, 1), "S", "global"), ("1", D(2026, 6, 1), None, "x")],
        "a string, d date, s string, r string",
    )
    got = [r[0] for r in df.select(record_id(*[F.col(c) for c in "adsr"])).collect()]
    assert got[0] == hashlib.sha256(b"1:2026-06-01:S:NoRegion").hexdigest()[:20]
    assert got[0] != got[1] and got[2] is None
    assert [r[0] for r in df.select(normalise_region(F.col("r"))).collect()] == ["global", "global", "x"]


def test_percent_rules(spark):
    df = spark.createDataFrame(
        [(150.0, 100.0), (150.0, 0.0), (150.0, -5.0), (150.0, None), (412.0, 150.0)], "t double, p double"
    )
    assert [r[0] for r in df.select(pct_change(F.col("t"), F.col("p"))).collect()] == [50.0, None, None, None, 174.7]
    limits = spark.createDataFrame([(100.0, 0.0), (80.0, 100.0), (100.0, 100.0)], "c double, l double")
    pct = pct_of_limit(F.col("c"), F.col("l"))
    assert rows(limits.select(pct, severity_for_pct(pct))) == [(0.0, "warning"), (80.0, "warning"), (100.0, "critical")]


def test_dates():
    assert months_back("2026-03-31", 6) == D(2025, 9, 1)
    assert month_end("2024-02-10") == D(2024, 2, 29)
    assert as_date("2026-01-02") == D(2026, 1, 2)
    for bad in (0, 367):
        with pytest.raises(ValueError):
            validate_days(bad)


# ---- feed


def page(*groups, day="2026-06-01"):
    return json.dumps(
        {
            "tenant_id": "t", "aws_account_id": "1", "account_alias": "one",
            "ResultsByTime": [
                {
                    "TimePeriod": {"Start": day, "End": day},
                    "Groups": [
                        {"Keys": k, "Metrics": {"UnblendedCost": {"Amount": c, "Unit": "USD"}, "UsageQuantity": {"Amount": u, **n}}}
                        for k, c, u, n in groups
                    ],
                }
            ],
        }
    )


def test_nested_feed(spark, tmp_path):
    (tmp_path / "1.json").write_text(
        page(
            (["Amazon EC2", "us-east-1"], "1.23456789", "2.00005", {"Unit": "Hrs"}),
            (["Amazon EC2", "NoRegion"], "-3", "0", {}),
            (["Amazon S3"], "0", "4", {}),
            (["Amazon S3", "eu-west-1"], "0", "0", {}),
            ([], "9", "0", {}),
        )
    )
    (tmp_path / "2.json").write_text(page((["Amazon EC2", "x"], "1", "1", {}), day="2026-06-15"))
    df = feed.cost_feed_daily(feed.feed_lines(feed.read_cost_feed(spark, str(tmp_path))), AS_OF)
    got = {(r.service, r.region): r for r in df.collect()}
    assert set(got) == {
        ("Amazon EC2", "us-east-1"), ("Amazon EC2", "global"), ("Amazon S3", "global"), ("Unknown", "global"),
    }  # the zero row and today are left out, the negative one and the usage-only one stay
    first = got[("Amazon EC2", "us-east-1")]
    assert (first.cost_usd, first.usage_quantity, first.usage_unit) == (Dec("1.234568"), Dec("2.0001"), "Hrs")
    assert first.tags == {} and first.provider == "aws" and first.raw_service_name == "Amazon EC2"
    assert got[("Amazon EC2", "global")].cost_usd == Dec("-3.000000")


def lines(spark, data):
    schema = "tenant_id string, aws_account_id string, date date, service string, raw_region string, record_type string, cost_usd decimal(18,6), usage_quantity decimal(18,4), usage_unit string"
    return spark.createDataFrame([(*r[:6], Dec(r[6]), Dec(r[7]), r[8]) for r in data], schema)


def test_rollup_and_monthly(spark):
    day = D(2026, 6, 1)
    df = lines(
        spark,
        [
            ("t", "1", day, "Amazon S3", "r", "Usage", "2", "1", "GB"),
            ("t", "1", day, "Amazon S3", "r", None, "1", "1", "Hrs"),
            ("t", "1", day, "Amazon S3", "r", "Credit", "-9", "1", "GB"),
            ("t", "1", day, "Amazon EC2", "r", "Usage", "5", "0", "Hrs"),
            ("t", "1", D(2025, 11, 30), "Amazon EC2", "r", "Usage", "5", "0", "Hrs"),
            ("t", "1", D(2025, 12, 1), "Amazon EC2", "r", "Usage", "7", "0", "Hrs"),
            ("t", "1", AS_OF, "Amazon EC2", "r", "Usage", "8", "0", "Hrs"),
        ],
    )
    cells = {(r.date, r.service): (r.cost_usd, r.usage_unit) for r in feed.usage_to_cost_rollup(df).collect()}
    assert cells[(day, "Amazon S3")] == (Dec("3.000000"), "N/A")
    assert cells[(day, "Amazon EC2")] == (Dec("5.000000"), "Hrs")
    monthly = {(r.date, r.service): r for r in feed.cost_feed_monthly(df, AS_OF).collect()}
    # Credits count, the start is the first of the month six months back, today does not count.
    assert {k: v.cost_usd for k, v in monthly.items()} == {
        (D(2026, 6, 1), "Amazon S3"): Dec("-6.000000"),
        (D(2026, 6, 1), "Amazon EC2"): Dec("5.000000"),
        (D(2025, 12, 1), "Amazon EC2"): Dec("7.000000"),
    }
    one = monthly[(D(2026, 6, 1), "Amazon EC2")]
    assert one.id == hashlib.sha256(b"1:2026-06-01:Amazon EC2:global").hexdigest()[:20] + "_m"
    assert (one.granularity, one.region, one.usage_quantity) == ("MONTHLY", "global", 0)


# ---- upsert and alerts


def cost_rows(spark, data):
    """(id, alias, cost, usage, ingested, seq)"""
    base = spark.createDataFrame(
        [(i, a, Dec(c), None if u is None else Dec(u), n, s) for i, a, c, u, n, s in data],
        "id string, account_alias string, cost_usd decimal(18,6), usage_quantity decimal(18,4), ing string, seq bigint",
    )
    have = {"id", "account_alias", "cost_usd", "usage_quantity"}
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in COST_RECORDS.fields if f.name not in have | {"ingested_at"}]
    df = base.select(*have, F.col("ing").cast("timestamp_ntz").alias("ingested_at"), *extra, "seq")
    return df.select(*COST_RECORDS.fieldNames(), "seq")


def test_upsert_columns(spark):
    old = cost_rows(spark, [("a", None, "1", "1", "2026-01-01", 0), ("b", "b0", "2", "2", "2026-01-01", 0)]).drop("seq")
    batch = cost_rows(
        spark,
        [
            ("a", "new", "5", "5", "2026-02-01", 1), ("a", "newer", "6", None, "2026-02-02", 2),
            ("c", "c1", "7", "7", "2026-02-01", 1), ("c", "c2", "8", "8", "2026-02-02", 2),
        ],
    )
    once = upsert_cost_records(old, batch)
    got = {r.id: (r.account_alias, r.cost_usd, r.usage_quantity, str(r.ingested_at)[:10]) for r in once.collect()}
    assert got == {
        "a": (None, 6, None, "2026-02-02"),  # first-seen NULL alias stays; last values win, NULL included
        "b": ("b0", 2, 2, "2026-01-01"),
        "c": ("c1", 8, 8, "2026-02-02"),
    }
    twice = upsert_cost_records(once, batch)
    assert sorted(map(str, rows(twice))) == sorted(map(str, rows(once)))
    empty = upsert_cost_records(old, batch.limit(0))
    assert sorted(map(str, rows(empty))) == sorted(map(str, rows(old)))


def test_same_account_under_two_tenants_keeps_the_first(spark):
    old = cost_rows(spark, [("a", "x", "1", "1", "2026-01-01", 0)]).drop("seq").withColumn("tenant_id", F.lit("t1"))
    new = cost_rows(spark, [("a", "y", "9", "1", "2026-01-02", 1)]).withColumn("tenant_id", F.lit("t2"))
    got = upsert_cost_records(old, new).first()
    assert (got.tenant_id, got.cost_usd) == ("t1", 9)


def alert_rows(spark, data):
    return spark.createDataFrame(data, "tenant_id string, budget_id string, severity string, state string, seq int")


def test_alert_dedup(spark):
    stored = alert_rows(
        spark, [("t", "b1", "warning", "firing", 0), ("t", "b2", "warning", "resolved", 0), ("t", None, "info", "firing", 0)]
    ).drop("seq")
    batch = alert_rows(
        spark,
        [
            ("t", "b1", "critical", "firing", 1),  # already firing; severity is not raised
            ("t", "b2", "warning", "firing", 2), ("t", "b2", "critical", "firing", 3),  # one per batch
            ("u", "b1", "warning", "firing", 4),  # other tenant
            ("t", None, "info", "firing", 5), ("t", None, "info", "firing", 6),  # no budget: always
        ],
    )
    got = sorted(rows(alert_dedup_append(batch, stored)), key=str)
    assert got == sorted(
        [("t", "b2", "warning", "firing"), ("u", "b1", "warning", "firing"), ("t", None, "info", "firing"), ("t", None, "info", "firing")],
        key=str,
    )


# ---- reads


def test_cost_summary_windows(spark):
    df = records(
        spark,
        [
            ("t", "1", D(2026, 6, 14), "Amazon S3", "r", 10), ("t", "1", D(2026, 5, 16), "Amazon S3", "r", 5),
            ("t", "1", D(2026, 6, 15), "Amazon S3", "r", 99),  # today
            ("t", "1", D(2026, 5, 15), "Amazon S3", "r", 4), ("t", "1", D(2026, 4, 16), "Amazon S3", "r", 1),
            ("t", "1", D(2026, 4, 15), "Amazon S3", "r", 99),  # before both windows
            ("t", "1", D(2026, 6, 1), "Amazon EC2", "r", 1), ("t", "1", D(2026, 5, 1), "Amazon EC2", "r", -1),
            ("t", "1", D(2026, 6, 1), "Amazon RDS", "r", 2),
            ("t", "1", D(2026, 5, 1), "Amazon VPC", "r", 50),  # only before: left out
        ],
    )
    got = rows(costs.cost_summary(df, AS_OF).drop("tenant_id"))
    assert got == [
        ("storage", Dec("15.00"), Dec("5.00"), 200.0, Dec("18.00")),
        ("database", Dec("2.00"), Dec("0.00"), None, Dec("18.00")),
        ("compute", Dec("1.00"), Dec("-1.00"), None, Dec("18.00")),
    ]
    open_ended = rows(costs.daily_costs(df, AS_OF, tenant_id="t").where("date = '2026-06-15'"))
    assert open_ended == [("t", AS_OF, Dec("99.00"))]
    monthly = df.withColumn("granularity", F.lit("MONTHLY"))
    assert costs.cost_summary(monthly, AS_OF).count() == 0


def test_total_of_nothing_is_one_zero_row(spark):
    none = records(spark, [("t", "1", D(2020, 1, 1), "Amazon S3", "r", 1)])
    assert rows(costs.cost_data_total(none, AS_OF, tenant_id="t")) == [("t", Dec("0.000000"))]
    assert costs.cost_data_by_service(none, AS_OF, tenant_id="t").count() == 0


def test_view_has_no_limit_and_overview_counts_stop_at_20(spark):
    df = records(spark, [("t", "1", D(2026, 6, 2), f"svc{i:02}", "r", 100 - i) for i in range(25)])
    assert costs.top_services_this_month_view(df, AS_OF).count() == 25
    assert costs.top_n_per_account(df, AS_OF).count() == 20
    inv = spark.createDataFrame(
        [("t", "1", f"i-{i:02}", "ec2", "compute", Dec(i), True) for i in range(30)],
        "tenant_id string, aws_account_id string, resource_id string, resource_type string, service_group string, monthly_cost_usd decimal(10,2), is_idle boolean",
    )
    one = rollups.build_overview(df, inv, AS_OF).first()
    assert (one.service_count, one.idle_resources, one.resource_summary.idle_resources) == (20, 20, 30)
    assert [s.service for s in one.top_services] == [f"svc{i:02}" for i in range(10)]
    assert one.total_usd == Dec("2200.00")


def test_service_count_counts_pairs(spark):
    df = records(spark, [("t", "1", D(2026, 6, 2), "s", "r", 1)] * 2)
    two = df.withColumn("service_group", F.explode(F.array(F.lit("other"), F.lit("compute"))))
    assert costs.cost_data_by_service(two, AS_OF, tenant_id="t").count() == 2


def test_gate(spark):
    df = spark.createDataFrame([("a", 0.0, 0), ("b", 0.0, 1), ("c", 1.0, 0), ("d", -1.0, 0)], "tenant_id string, total_usd double, total_resource_types int")
    assert {r.tenant_id: r.success for r in rollups.insights_gate(df).collect()} == {"a": False, "b": True, "c": True, "d": False}


def test_slice_query_rejects_unknown_columns(spark):
    df = records(spark, [("t", "1", D(2026, 5, 2), "Amazon EC2", "r", 3), ("t", "1", D(2026, 4, 2), "Amazon EC2", "r", 2)])
    got = costs.slice_query(df, start="2026-05-01", end="2026-06-01", compare_start="2026-04-01", service="Amazon EC2")
    assert rows(got) == [("t", "Amazon EC2", Dec("3.000000"), Dec("2.000000"), 50.0)]
    for bad in ({"metric": "x"}, {"group_by": ("tags",)}, {"nope": 1}):
        with pytest.raises(ValueError):
            costs.slice_query(df, **bad)


def test_idle_order_puts_unknown_cost_first(spark):
    inv = spark.createDataFrame(
        [("t", "i-1", "x", "n", Dec("45.50"), 1.0, 1.0, "idle", True), ("t", "i-2", "x", "n", None, 1.0, 1.0, "idle", True),
         ("t", "i-3", "x", "n", Dec("15.00"), 1.0, 1.0, "idle", True), ("t", "i-4", "x", "n", Dec("99.00"), 1.0, 1.0, "running", False)],
        "tenant_id string, resource_id string, resource_type string, name string, monthly_cost_usd decimal(10,2), cpu_avg_pct double, memory_avg_pct double, state string, is_idle boolean",
    )
    assert [r.resource_id for r in inventory.idle_resources(inv, tenant_id="t").collect()] == ["i-2", "i-1", "i-3"]
    assert [r.resource_id for r in inventory.idle_resources(inv, limit=2).collect()] == ["i-2", "i-1"]


def test_idle_needs_14_days(spark):
    def sample(rid, day, cpu):
        return ("t", "1", rid, "ec2", "compute", "r", "n", dt.datetime(2026, 6, day), Dec(cpu), Dec("1"), Dec("10"))

    df = spark.createDataFrame(
        [sample("old", 1, "4"), sample("old", 10, "4"), sample("new", 2, "4"), sample("edge", 1, "5"), sample("gone", 1, "1")],
        "tenant_id string, aws_account_id string, resource_id string, resource_type string, service_group string, region string, name string, ts timestamp_ntz, cpu_pct decimal(12,6), memory_pct decimal(12,6), monthly_cost_usd decimal(10,2)",
    )
    got = {r.resource_id: (r.is_idle, r.state) for r in inventory.resource_inventory(df, AS_OF).collect()}
    assert got == {"old": (True, "idle"), "new": (False, "running"), "edge": (False, "running"), "gone": (True, "idle")}
    later = {r.resource_id: (r.is_idle, r.state) for r in inventory.resource_inventory(df, D(2026, 7, 15)).collect()}
    assert later["gone"] == (False, "stopped")


# ---- budgets


def budget(spark, data):
    schema = "id string, tenant_id string, name string, aws_account_id string, service_group string, region string, limit_usd decimal(12,2), period string, alert_at_pct int, is_active boolean"
    return spark.createDataFrame([(i, "t", i, a, g, r, Dec(str(l)), p, 80, True) for i, a, g, r, l, p in data], schema)


def spend(spark):
    return records(
        spark,
        [
            ("t", "1", D(2026, 6, 1), "Amazon EC2", "us", 50), ("t", "1", D(2026, 6, 14), "Amazon S3", "eu", 30),
            ("t", "2", D(2026, 6, 10), "Amazon EC2", "eu", 20), ("t", "1", D(2026, 5, 31), "Amazon EC2", "us", 999),
            ("t", "1", AS_OF, "Amazon EC2", "us", 7),
        ],
    )


def test_wildcards_and_scopes(spark):
    b = budget(
        spark,
        [
            ("all", None, None, None, 100, "daily"), ("one", "1", None, None, 100, "monthly"),
            ("ec2", None, "compute", None, 100, "monthly"), ("eu", None, None, "eu", 100, "monthly"),
            ("exact", "1", "compute", "us", 0, "monthly"), ("none", "1", None, "mars", 100, "monthly"),
        ],
    )
    accounts = spark.createDataFrame([("t", "1"), ("t", "2"), ("t", "3")], "tenant_id string, aws_account_id string")
    tenant = {r.budget_id: r for r in budgets.budget_status(spend(spark), b, AS_OF, "tenant").collect()}
    assert {k: float(v.current_usd) for k, v in tenant.items()} == {
        "all": 100, "one": 80, "ec2": 70, "eu": 50, "exact": 50, "none": 0,
    }
    assert {k: v.severity for k, v in tenant.items()} == {
        "all": "critical", "one": "warning", "ec2": "ok", "eu": "ok", "exact": "ok", "none": "ok",
    }  # fires at exactly 80 %; a zero limit is 0 %; a daily budget is measured over the month too
    account = {(r.budget_id, r.evaluated_account): float(r.current_usd) for r in budgets.budget_status(spend(spark), b, AS_OF, "account", accounts).collect()}
    assert {k: v for k, v in account.items() if k[0] in ("all", "one")} == {
        ("all", "1"): 80, ("all", "2"): 20, ("all", "3"): 0, ("one", "1"): 80,
    }
    period = {r.budget_id: float(r.current_usd) for r in budgets.budget_status_by_period(spend(spark), b, AS_OF).collect()}
    assert period["all"] == 7 and period["one"] == 87


def test_alert_text_and_lifecycle(spark):
    b = budget(spark, [("EC2", None, None, None, 120, "monthly"), ("big", None, None, None, 100000, "monthly")])
    status = budgets.budget_status(spend(spark), b, AS_OF, "tenant")
    now = F.lit("2026-06-15 00:00:00").cast("timestamp_ntz")
    fired = budgets.budget_alerts(status, now).collect()
    assert [r.message for r in fired] == ["Budget alert: 'EC2' is at 83.3% — $100.00 of $120.00"]
    stored = spark.createDataFrame(
        [("a", "t", "EC2", "firing"), ("b", "t", "big", "firing"), ("c", "t", "gone", "firing"), ("d", "t", "big", "acknowledged"), ("e", "t", None, "firing")],
        "id string, tenant_id string, budget_id string, state string",
    )
    got = {r.id: (r.state, r.resolved_at is not None) for r in alerts.alert_lifecycle(stored, status, now).collect()}
    assert got == {"a": ("firing", False), "b": ("resolved", True), "c": ("firing", False), "d": ("acknowledged", False), "e": ("firing", False)}


def test_active_budgets_for_account(spark):
    b = budget(spark, [("x", "1", None, None, 1, "monthly"), ("y", "2", None, None, 1, "monthly"), ("z", None, None, None, 1, "monthly")])
    assert {r.id for r in tables.active_budgets(b, "t", "1").collect()} == {"x", "z"}
    assert tables.active_budgets(b, "t").count() == 3


# ---- anomalies and forecasts


def constant(spark, per_day, days, until=AS_OF, account="1", service="Amazon EC2"):
    return [("t", account, until - dt.timedelta(days=i), service, "r", per_day) for i in range(1, days + 1)]


def test_spike_is_the_increase(spark):
    data = constant(spark, 150, 97)
    data = [(*r[:5], 412) if (AS_OF - r[2]).days <= 7 else r for r in data]
    one = anomaly.spend_spikes(records(spark, data), AS_OF).first()
    assert (one.percent_change, one.severity, one.current_value) == (Dec("174.67"), "warning", Dec("412.00"))
    steady = records(spark, constant(spark, 100, 97))
    assert anomaly.spend_spikes(steady, AS_OF).count() == 0 and anomaly.new_services(steady, AS_OF).count() == 0


def test_baseline_of_a_series_with_gaps(spark):
    one = anomaly.baseline_stats(records(spark, [("t", "1", D(2026, 6, d), "s", "r", c) for d, c in [(8, 450), (9, 200), (14, 1450)]] + [("t", "1", D(2026, 6, 1), "s", "r", 90)]), AS_OF).first()
    assert (one.current_total, one.current_avg, one.current_peak, one.current_low) == (Dec("2100.00"), 300, 1450, 0)
    import statistics

    assert one.avg_daily == 1 and abs(one.std_dev - statistics.stdev([90] + [0] * 89)) < 1e-3


SERIES = [150, 155, 160, 158, 165, 170, 168, 172, 175, 178, 180, 182, 185, 188, 190, 192] + [195] * 44


def test_forecast_against_numpy(spark):
    import numpy as np

    start = AS_OF - dt.timedelta(days=60)
    df = records(spark, [("t", "1", start + dt.timedelta(days=i), "s", "r", v) for i, v in enumerate(SERIES)])
    x, y = np.arange(60), np.array(SERIES, float)
    slope, icept = np.polyfit(x, y, 1)
    mtd = y[-14:].sum()
    expected = mtd + sum(max(0, icept + slope * (60 + k)) for k in range(16))
    one = forecast.forecast_linear(df, AS_OF).first()
    assert abs(one.projected_month_end_usd - expected) < 1e-3
    assert abs(one.confidence_level - np.corrcoef(x, y)[0, 1] ** 2) < 1e-4
    b = budget(spark, [("b", "1", None, None, 2950, "monthly"), ("zero", "1", None, None, 0, "monthly")])
    got = {r.budget_id: r for r in forecast.budget_breach(df, b, AS_OF).collect()}
    cumulative = mtd + np.cumsum([icept + slope * (60 + k) for k in range(16)])
    assert got["b"].days_to_breach == int(np.argmax(cumulative >= 2950)) + 1
    z = (expected - 2950) / (y.std(ddof=1) * 4)
    assert abs(got["b"].budget_breach_probability - 1 / (1 + np.exp(-1.702 * z))) < 1e-4
    assert got["zero"].budget_limit == 10000 and got["zero"].days_to_breach is None  # 0 becomes the default
    assert forecast.budget_breach(df, b.limit(0), AS_OF).first().budget_limit == 10000


def test_forecast_of_a_constant_is_constant(spark):
    df = records(spark, constant(spark, 10, 60))
    for f in (forecast.forecast_linear, forecast.forecast_exponential, forecast.forecast_seasonal):
        one = f(df, AS_OF).first()
        assert abs(one.projected_month_end_usd - 300) < 1e-6, one
    one = forecast.forecast_interval(df, AS_OF).first()
    assert (one.mean_usd, one.lower_usd, one.upper_usd) == (300, 300, 300)
    breach = forecast.budget_breach(df, budget(spark, [("b", "1", None, None, 140, "monthly")]), AS_OF).first()
    assert (breach.days_to_breach, breach.budget_breach_probability) == (0, 1.0)


def test_year_ago_of_leap_days(spark):
    df = records(spark, [("t", "1", D(2023, 2, 28), "s", "r", 1), ("t", "1", D(2024, 2, 28), "s", "r", 2), ("t", "1", D(2024, 2, 29), "s", "r", 4), ("t", "1", D(2025, 2, 28), "s", "r", 8)])
    got = {r.period_start: r.year_ago_usd for r in trends.period_over_period(df, "day").collect()}
    assert got == {D(2023, 2, 28): None, D(2024, 2, 28): 1, D(2024, 2, 29): 1, D(2025, 2, 28): 2}


# ---- documents, tags, jobs


@pytest.mark.parametrize(
    "text, body",
    [
        ("x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'), ("```\n[1]\n```", "[1]"), ("  {} \n", "{}"),
        ("```json\n{\"a\": 1}", '{"a": 1}'), ("```python\n1\n```", "python\n1"), ("``` a ``` ```json b ```", "b"),
    ],
)
def test_fences(spark, text, body):
    assert spark.createDataFrame([(text,)], "t string").select(fenced_json(F.col("t"))).first()[0] == body


def test_bad_json_keeps_raw(spark):
    df = spark.createDataFrame([("```json\n{\"a\": \n```",), ("[{\"a\": 1}]",)], "response_text string")
    got = agents.fenced_json_extract(df).collect()
    assert [(r.success, r.raw_response is None) for r in got] == [(False, False), (True, True)]


def test_rate_card_order(spark):
    df = spark.createDataFrame([(m, 1_000_000, 1_000_000) for m in ("claude-x", "gpt-4o-mini", "gpt-4-turbo", "o1")], "m string, i int, o int")
    got = [float(r[0]) for r in df.select(agents.token_cost(F.col("m"), F.col("i"), F.col("o"))).collect()]
    assert got == [18.0, 12.5, 90.0, 2.0]


def test_cache_key_is_the_hash_of_sorted_json(spark):
    params = {"b": 'x"y\\z', "a": "1"}
    df = spark.createDataFrame([(params,)], "params map<string,string>")
    text = json.dumps(params, sort_keys=True)
    assert df.select(sorted_json(F.col("params"))).first()[0] == text
    assert agents.with_cache_key(df).first().cache_key == hashlib.sha256(text.encode()).hexdigest()


def test_tags(spark):
    df = spark.createDataFrame([('{"team": "a"}', 1), ("{}", 2), (None, 3), ('{"env": "p"}', 4)], "tags_json string, c int").select("tags_json", F.col("c").cast("decimal(18,6)").alias("cost_usd"), F.lit("t").alias("tenant_id"))
    got = {r.tag_value: int(r.total_usd) for r in tags.tag_chargeback(df, "team").collect()}
    assert got == {"a": 1, "(untagged)": 9}
    assert tags.tag_pairs(df).count() == 4


def test_sync_status(spark):
    accounts = spark.createDataFrame([("t", "1"), ("t", "2"), ("t", "3")], "tenant_id string, aws_account_id string").select("*", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_synced_at"), F.lit(None).cast("string").alias("last_error"))
    jobs_df = spark.createDataFrame(
        [("t", "1", 1, "error", ["x"], dt.datetime(2026, 1, 1)), ("t", "1", 2, "success", None, dt.datetime(2026, 1, 2)), ("t", "2", 3, "error", ["IAM permission error: no", "Unexpected: z"], dt.datetime(2026, 1, 2)), ("t", "3", 4, "running", None, None)],
        "tenant_id string, aws_account_id string, job_id int, status string, errors array<string>, completed_at timestamp_ntz",
    )
    got = {r.aws_account_id: (r.status, r.last_error) for r in jobs.account_sync_status(accounts, jobs_df).collect()}
    assert got == {"1": ("active", None), "2": ("error", "IAM permission error: no; Unexpected: z"), "3": ("pending", None)}


def test_recommendation_defaults_and_export(spark):
    docs = spark.createDataFrame([("t", None, "{}"), ("t", "1", '{"title": "x", "estimated_savings_monthly_usd": 45.5, "action_steps": [{"step": 1, "details": "d"}]}')], "tenant_id string, aws_account_id string, doc string")
    got = {r.title: r for r in recommendations_table(docs, F.lit("2026-06-15").cast("timestamp_ntz")).collect()}
    assert (got[""].recommendation_type, got[""].priority, got[""].estimated_savings_usd, got[""].action_steps, got[""].status) == ("other", "medium", 0, [], "pending")
    assert got["x"].estimated_savings_usd == Dec("45.50") and got["x"].action_steps[0].details == "d"
    text = json_export(spark.sql("select 'b' as z, cast(1.5 as decimal(5,2)) as a, cast(null as string) as m")).first()[0]
    assert text == '{"a":1.50,"m":null,"z":"b"}'


def test_quality(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x"), (None, "y")], "k string, v string")
    assert quality.duplicate_keys(df, ["k"], "c").first().violations == 1
    assert quality.outside_domain(df, "v", ["x"], "c").first().violations == 1


def test_failed_read_raises(spark, tmp_path):
    with pytest.raises(Exception):
        feed.feed_lines(feed.read_cost_feed(spark, str(tmp_path / "missing"))).count()
