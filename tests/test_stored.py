"""The stored fact table: pruning, replaced months, repeated batches; and what must never be lost on the way to it."""

import datetime as dt
import hashlib
import json
import os
import random
import re
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlight.operators import anomaly, budgets, costs, forecast, insights, inventory, rollups, rootcause
from ledgerlight.plans.sync import touched_months
from ledgerlight.sinks import append_table, carried, carry, earlier_batches, upsert_cost_records, write_cost_table
from ledgerlight.sources import feed, sample, tables
from ledgerlight.sources.sample import AS_OF


@pytest.fixture(scope="module")
def fact_path(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "cost_records")
    write_cost_table(sample.cost_records(spark, sf_dir), path)
    return path


DATED = {
    "cost_summary": lambda f: costs.cost_summary(f, AS_OF),
    "daily_costs": lambda f: costs.daily_costs(f, AS_OF),
    "top_services": lambda f: costs.top_services(f, AS_OF),
    "costs_by_region": lambda f: costs.costs_by_region(f, AS_OF),
    "monitoring_facets": lambda f: costs.monitoring_facets(f, AS_OF),
    "spend_spikes": lambda f: anomaly.spend_spikes(f, AS_OF),
    "new_services": lambda f: anomaly.new_services(f, AS_OF),
    "regional_shift": lambda f: anomaly.regional_shift(f, AS_OF),
    "forecast_linear": lambda f: forecast.forecast_linear(f, AS_OF),
    "rca_contribution": lambda f: rootcause.rca_contribution(f, AS_OF),
    "rca_joint_split": lambda f: rootcause.rca_joint_split(f, AS_OF),
    "month_to_date_slices": lambda f: budgets.month_to_date_slices(f, AS_OF),
    "multi_account_rollup": lambda f: rollups.multi_account_rollup(tables.scoped(f, start="2001-08-01", end=AS_OF)),
    "touched_months": lambda f: touched_months(f, AS_OF),
}


@pytest.mark.parametrize("name", list(DATED))
def test_dated_reads_prune_months(spark, fact_path, name):
    plan = DATED[name](spark.read.parquet(fact_path))._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)
    assert scans and all("month" in s and ">=" in s for s in scans), plan


def test_sixty_days_list_few_months(spark, fact_path):
    rows = tables.scan_cost_records(spark.read.parquet(fact_path), start=AS_OF - dt.timedelta(days=60), end=AS_OF)
    months = {re.search(r"month=([\d-]+)", r[0])[1] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert months == {"2001-07-01", "2001-08-01", "2001-09-01"}
    whole = spark.read.parquet(fact_path).where(f"date >= DATE'{AS_OF}' - 60 AND date < DATE'{AS_OF}'")
    assert rows.count() == whole.count() > 0


def digest(folder):
    return {f: hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_a_batch_leaves_other_months_alone(spark, sf_dir, tmp_path):
    path = str(tmp_path / "facts")
    records = sample.cost_records(spark, sf_dir)
    write_cost_table(records, path)
    before, count = digest(path), spark.read.parquet(path).count()
    months = len(os.listdir(path))
    stored = tables.scoped(spark.read.parquet(path), start="2001-08-01", end="2001-10-01")
    batch = records.where("date >= DATE'2001-08-01' AND date < DATE'2001-10-01'").withColumn("cost_usd", (F.col("cost_usd") * 2).cast("decimal(18,6)")).withColumn("seq", F.lit(1).cast("bigint"))
    write_cost_table(upsert_cost_records(stored, batch), path)
    after = spark.read.parquet(path)
    assert after.count() == count and len(os.listdir(path)) == months
    same = {f for f, d in digest(path).items() if before.get(f) == d}
    touched = {f for m in ("2001-08-01", "2001-09-01") for f in os.listdir(f"{path}/month={m}")}
    assert same == set(digest(path)) - touched and same
    twice = after.where("month = DATE'2001-08-01'").agg(F.sum("cost_usd")).first()[0]
    assert twice == 2 * records.where("date >= DATE'2001-08-01' AND date < DATE'2001-09-01'").agg(F.sum("cost_usd")).first()[0]
    write_cost_table(records.where("date < DATE'2000-01-01'"), path, whole=True)
    assert spark.read.parquet(path).where("date >= DATE'2000-01-01'").count() == 0


def test_appends_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "alerts")
    for batch, n in ((0, 3), (1, 2), (1, 2)):
        append_table(spark.range(n), path, batch)
    assert spark.read.parquet(path).count() == 5


def test_an_account_of_two_tenants_stays_with_the_first(spark):
    schema = "tenant_id string, aws_account_id string, account_alias string, date date, service string, raw_region string, record_type string, cost_usd double, usage_quantity double"
    day = AS_OF - dt.timedelta(days=1)
    rows = [("b", "1", "x", day, "Amazon S3", "r", "Usage", 2.0, 1.0), ("a", "1", "y", day, "Amazon S3", "r", "Usage", 5.0, 1.0)]
    order = F.struct("tenant_id", "granularity", "region", "service", "date", "cost_usd", "usage_quantity", "usage_unit")
    found = set()
    for some in (rows, rows[::-1]):
        daily = feed.cost_feed_daily(feed.usage_cells(spark.createDataFrame(some, schema).coalesce(1)), AS_OF)
        merged = upsert_cost_records(daily.limit(0), daily.withColumn("seq", order)).collect()
        found.add(tuple((r.tenant_id, r.cost_usd) for r in merged))
    assert found == {(("a", Decimal("2.000000")),)}


def test_tiny_charges_add_up(spark):
    rows = [("t", "1", dt.date(2001, 9, 1), "AWS Lambda", "r", "Usage", 2e-7, 0.00001)] * 1000 + [("t", "1", dt.date(2001, 9, 1), "AWS Lambda", "x", "Usage", -1.5, 0.0)]
    double = spark.createDataFrame(rows, "tenant_id string, aws_account_id string, date date, service string, raw_region string, record_type string, cost_usd double, usage_quantity double")
    exact = double.withColumn("cost_usd", F.col("cost_usd").cast("decimal(30,12)")).withColumn("usage_quantity", F.col("usage_quantity").cast("decimal(30,12)"))
    for lines in (double, exact):
        got = {r.raw_region: (r.cost_usd, r.usage_quantity) for r in feed.usage_to_cost_rollup(lines).collect()}
        assert got == {"r": (Decimal("0.000200"), Decimal("0.0100")), "x": (Decimal("-1.500000"), Decimal("0.0000"))}
        monthly = feed.cost_feed_monthly(lines, AS_OF).collect()
        assert [r.cost_usd for r in monthly] == [Decimal("-1.499800")]


def pages(tmp_path, *amounts):
    groups = [{"Keys": ["Amazon S3", f"r{i}"], "Metrics": {"UnblendedCost": {"Amount": c}, "UsageQuantity": {"Amount": u}}} for i, (c, u) in enumerate(amounts)]
    page = {"tenant_id": "t", "aws_account_id": "1", "ResultsByTime": [{"TimePeriod": {"Start": "2001-09-01"}, "Groups": groups}]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    return str(tmp_path)


def read(spark, path):
    return feed.cost_feed_daily(feed.feed_lines(feed.read_cost_feed(spark, path)), AS_OF).collect()


def test_tiny_feed_rows_stay(spark, tmp_path):
    rows = read(spark, pages(tmp_path, ("0.0000001336", "0.00001"), ("1.336E-7", "0"), ("0", "0"), ("0.000000", "0E-3")))
    assert sorted((r.region, r.cost_usd, r.usage_quantity) for r in rows) == [("r0", Decimal("0.000000"), Decimal("0.0000")), ("r1", Decimal("0.000000"), Decimal("0.0000"))]


@pytest.mark.parametrize("bad", [("n/a", "0"), ("n/a", "5"), ("1", None), ("", "1")])
def test_bad_amounts_fail_the_read(spark, tmp_path, bad):
    with pytest.raises(PySparkException):
        read(spark, pages(tmp_path, ("1", "1"), bad))


def test_cut_pages_fail_the_read(spark, tmp_path):
    path = pages(tmp_path, ("1", "1"))
    text = (tmp_path / "page.json").read_text()
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    with pytest.raises((PySparkException, Py4JJavaError)):
        read(spark, path)


def test_open_anomalies_keep_their_changes(spark):
    start = dt.datetime(2026, 6, 2, 14)
    changes = [(i, "a", "r", "created", start + dt.timedelta(hours=h)) for i, h in enumerate((-2, 0, 5, 23, 30, 70))]
    frame = spark.createDataFrame(changes, "change_id int, aws_account_id string, resource_id string, action string, changed_at timestamp_ntz")
    open_one = spark.createDataFrame([("x", "a", start, None)], "anomaly_id string, aws_account_id string, start_at timestamp_ntz, end_at timestamp_ntz")
    near = lambda **more: {r.change_id for r in rootcause.rca_change_correlation(open_one, frame, **more).collect()}
    assert near() == {1, 2, 3}
    assert near(as_of=dt.datetime(2026, 6, 4)) == {1, 2, 3, 4}
    assert near(as_of=dt.datetime(2026, 6, 1)) == {1}


def test_rings_equal_the_full_read_and_read_one_day(spark, tmp_path):
    rnd, first = random.Random(11), dt.datetime(2026, 6, 1)
    schema = "tenant_id string, aws_account_id string, resource_id string, ts timestamp_ntz, cpu_pct decimal(12,6), memory_pct decimal(12,6), monthly_cost_usd decimal(24,2), resource_type string, service_group string, region string, name string"
    rows = []
    for i in range(4000):
        # Some resources start late, stop early, change their name, miss figures, or have no tenant.
        r = rnd.choice([0, 0, 0, *range(1, 12)])
        lo, hi = (12, 30) if r == 3 else (0, 9) if r == 4 else (0, 30)
        at = first + dt.timedelta(days=rnd.randrange(lo, hi), seconds=i)
        figure = lambda top: None if r == 5 or rnd.random() < 0.1 else Decimal(rnd.randrange(top))
        name = f"n{at.day // 10}" if r == 6 else "n"
        rows.append((None if r == 7 else "t", "1", f"i-{r}", at, figure(9 if r % 2 else 60), figure(90), Decimal(r), "ec2", "compute", "eu", name))
    path = str(tmp_path / "samples")
    spark.createDataFrame(rows, schema).write.parquet(path)
    samples = spark.read.parquet(path)
    rings = inventory.resource_rings(samples, "2026-06-10")
    kind, folder = rings.schema, str(tmp_path / "rings")
    carry(rings, folder, 0)
    for run in range(1, 18):
        day = dt.date(2026, 6, 9) + dt.timedelta(days=run)
        moved = inventory.advance_rings(carried(spark, folder, kind, run), samples, day)
        carry(moved, folder, run)
        if run in (1, 8, 17):
            now, as_of = carried(spark, folder, kind, run + 1), day + dt.timedelta(days=1)
            assert now.agg(F.max(F.size("days"))).first()[0] <= 14
            again = inventory.advance_rings(now, samples, day)  # a day that is folded in twice
            expected = inventory.resource_inventory(samples, as_of)
            for state in (now, again):
                got = inventory.inventory_from_rings(state, as_of).select(*expected.columns)
                assert got.count() == expected.count() > 5 and got.exceptAll(expected).count() == 0, run
    text = moved._jdf.queryExecution().executedPlan().toString()
    pushed = next(p for p in re.findall(r"PushedFilters: \[(.*?)\]", text) if "ts" in p)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed, pushed


def test_a_year_is_cut_into_few_pieces(spark):
    spans = [(0, 0), (5, 20), (16, 31), (15, 4097), (1, 8760), (4000, 60000), (-40, 300), (7, 6)]
    frame = spark.createDataFrame(spans, "a bigint, b bigint")
    for r in frame.select("a", "b", rootcause.span_pieces(F.col("a"), F.col("b")).alias("p")).collect():
        hours = [p.piece * rootcause.WIDTHS[p.level] + i for p in r.p for i in range(rootcause.WIDTHS[p.level])]
        assert sorted(hours) == list(range(r.a, r.b + 1)), (r.a, r.b)
        assert len(r.p) < 100 + (r.b - r.a) // 4096


def test_top_changes_of_an_open_anomaly(spark):
    start = dt.datetime(2026, 6, 2, 14)
    at = lambda i: start + dt.timedelta(minutes=(i * 7919) % 500_000 - 30)
    changes = [(i, "a", "r", "created", at(i)) for i in range(3000)] + [(9000 + i, "a", "r", "created", start) for i in range(4)]
    frame = spark.createDataFrame(changes, "change_id int, aws_account_id string, resource_id string, action string, changed_at timestamp_ntz")
    open_one = spark.createDataFrame([("x", "a", start, None), ("y", "b", start, None)], "anomaly_id string, aws_account_id string, start_at timestamp_ntz, end_at timestamp_ntz")
    whole = rootcause.rca_change_correlation(open_one, frame, as_of=dt.datetime(2027, 6, 2)).collect()
    assert {r.change_id for r in whole} == {c[0] for c in changes}
    best = sorted(whole, key=lambda r: (abs(r.lag_minutes), r.change_id))
    for top in (0, 3, 50):
        got = rootcause.rca_change_correlation(open_one, frame, as_of=dt.datetime(2027, 6, 2), top=top)
        assert sorted((r.change_id, r.closeness_rank) for r in got.collect()) == sorted((r.change_id, r.closeness_rank) for r in best[:top])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["anomaly_events", "forecast_records"])
def test_one_scan_for_all_detectors_and_methods(spark, sf_dir, fact_path, name):
    facts = spark.read.parquet(fact_path)
    limits = sample.budgets(spark, sf_dir, sample.cost_records(spark, sf_dir))
    df = anomaly.anomaly_events(facts, AS_OF) if name == "anomaly_events" else forecast.forecast_records(facts, limits, AS_OF)
    text = df._jdf.queryExecution().executedPlan().toString()
    found = [s for s in re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters", text, re.S) if "month" in s]
    assert len(found) == 1 and ">=" in found[0], text


@pytest.mark.parametrize("kind", ["daily", "weekly", "monthly"])
def test_reports_read_two_windows_of_months(spark, sf_dir, fact_path, kind, monkeypatch):
    plans, write = [], rollups.materialise
    monkeypatch.setattr(rollups, "materialise", lambda df, name: (plans.append(df), write(df, name))[1])
    limits = sample.budgets(spark, sf_dir, sample.cost_records(spark, sf_dir))
    plans.append(rollups.cost_report(spark.read.parquet(fact_path), limits, AS_OF, kind))
    scans = []
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        scans += [s for s in re.findall(r"FileScan parquet.*?PartitionFilters: \[(.*?)\], PushedFilters", text, re.S) if "month" in s]
    assert len(scans) == 2 and all(">=" in s and "<=" in s for s in scans), scans


def test_a_repeated_batch_does_not_see_itself(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a",)], "x string")
    assert earlier_batches(spark, path, rows.schema, 0).count() == 0
    append_table(rows, path, 0)
    for _ in range(2):
        assert [r.x for r in earlier_batches(spark, path, rows.schema, 1).collect()] == ["a"]
        append_table(spark.createDataFrame([("b",)], "x string"), path, 1)
    assert sorted(r.x for r in earlier_batches(spark, path, rows.schema, 2).collect()) == ["a", "b"]


def test_insights_of_a_tenant_without_data(spark, sf_dir):
    costs = sample.cost_records(spark, sf_dir)
    stock = inventory.resource_inventory(sample.resource_utilization(spark, sf_dir), sample.EVENTS_AS_OF)
    tenants = spark.createDataFrame([("nobody",), ("BUILDING",)], "tenant_id string")
    rows = {r.tenant_id: r for r in insights.monitoring_insights(costs, stock, AS_OF, tenants=tenants, n=3).collect()}
    nobody, someone = rows["nobody"], rows["BUILDING"]
    assert (nobody.success, nobody.message, nobody.recommendations) == (False, "no_data", [])
    assert someone.success and [r["rank"] for r in someone.recommendations] == [1, 2, 3]
    assert someone.recommendations[0].action_steps[0].step == 1
    one = insights.monitoring_insights(costs, stock, AS_OF, tenant_id="BUILDING").collect()
    assert [r.tenant_id for r in one] == ["BUILDING"]
    with pytest.raises(ValueError):
        insights.monitoring_insights(costs, stock, AS_OF, days=367)


def test_smoothing_learns_weekdays_and_trends(spark):
    first, as_of = dt.date(2026, 4, 2), "2026-06-01"
    weekly = lambda i: Decimal(10 + 5 * (i % 7 == 3))
    rising = lambda i: Decimal(100 + 2 * i)
    rows = [("t", name, first + dt.timedelta(days=i), "DAILY", f(i)) for name, f in (("weekly", weekly), ("rising", rising)) for i in range(60)]
    rows.append(("t", "once", first + dt.timedelta(days=20), "DAILY", Decimal(7)))
    facts = spark.createDataFrame(rows, "tenant_id string, aws_account_id string, date date, granularity string, cost_usd decimal(18,6)")
    got = {r.aws_account_id: r for r in forecast.forecast_ml(facts, as_of).collect()}
    month = range(60, 90)
    assert got["weekly"].projected_month_end_usd == sum(weekly(i) for i in month) and got["weekly"].confidence_level == 1
    whole = float(sum(rising(i) for i in month))
    assert abs(got["rising"].projected_month_end_usd - whole) < 0.1 * whole
    assert got["once"].projected_month_end_usd >= 0 and 0 <= got["once"].confidence_level <= 1
    assert forecast.forecast_ml(facts.limit(0), as_of).count() == 0
