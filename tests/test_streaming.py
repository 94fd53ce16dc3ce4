"""Streams over split files against the batch result."""

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import costs
from ledgerlight.operators.rootcause import change_sessions
from ledgerlight.plans.stream_plans import event_records
from ledgerlight.sinks import alert_changes, carried, carry, compact_log, merge_on_read, update_view_cells, upsert_cost_records, view_cells, write_delta
from ledgerlight.sinks.upsert import _log, fold
from ledgerlight.sources import sample
from ledgerlight.streaming import streams as S

SCHEMA = "tenant_id string, service string, ts timestamp_ntz, cost_usd decimal(18,6)"


def part(spark, path, rows):
    """One more file of the source folder, older than the next."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def line(day, cost, month=6, service="s"):
    return ("t", service, dt.datetime(2026, month, day, 12), Decimal(cost))


def test_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.mkdir(src)
    agg = S.stream_daily_spend(source(spark, src))

    def run():
        S.run_updates(agg, f"{out}/t", f"{out}/c")

    part(spark, src, [line(1, 10), line(30, 5)])
    run()
    part(spark, src, [line(2, 3), line(31, 1, month=7)])
    run()
    part(spark, src, [line(29, 7), line(1, 100), line(31, 1, month=7)])  # 32 days late at most / far too late
    run()
    got = {r.date: int(r.total_usd) for r in S.latest_updates(spark, f"{out}/t", agg.schema, ["date", "tenant_id", "service"]).collect()}
    assert got == {dt.date(2026, 6, 1): 10, dt.date(2026, 6, 2): 3, dt.date(2026, 6, 29): 7, dt.date(2026, 6, 30): 5, dt.date(2026, 7, 31): 2}


def test_append_mode_emits_closed_days(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    part(spark, src, [line(1, 10), line(1, 2), line(5, 5)])
    part(spark, src, [("t", "s", dt.datetime(2030, 1, 1), Decimal(1))])
    agg = S.stream_daily_spend(source(spark, src))
    query = agg.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.date: int(r.total_usd) for r in spark.read.parquet(f"{out}/t").collect()}
    assert got == {dt.date(2026, 6, 1): 12, dt.date(2026, 6, 5): 5}


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """The event table in four files."""
    path = str(tmp_path_factory.mktemp("events") / "src")
    sample.table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(path)
    return path


def events_stream(spark, path, sf_dir):
    schema = sample.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_daily_stream_equals_batch(spark, sf_dir, split_events, tmp_path):
    agg = S.stream_daily_spend(sample.event_lines(events_stream(spark, split_events, sf_dir)))
    S.run_updates(agg, str(tmp_path / "t"), str(tmp_path / "c"))
    assert len([d for d in os.listdir(tmp_path / "t") if d.startswith("batch_id")]) >= 4
    got = S.latest_updates(spark, str(tmp_path / "t"), agg.schema, ["date", "tenant_id", "service"])
    batch = sample.tagged_lines(spark, sf_dir).groupBy("date", "tenant_id", "service").agg(F.sum("cost_usd").cast("decimal(28,6)").alias("total_usd"))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_upsert_stream_equals_batch_and_is_idempotent(spark, sf_dir, split_events, tmp_path):
    path = str(tmp_path / "t")
    S.stream_upsert_cost(event_records(events_stream(spark, split_events, sf_dir)), path, str(tmp_path / "c"))
    batch = event_records(sample.table(spark, sf_dir, "events"))
    expected = upsert_cost_records(batch.limit(0).drop("seq"), batch).drop("tags")
    got = merge_on_read(spark, path).drop("tags")
    assert got.count() == expected.count() > 0
    assert got.exceptAll(expected).count() == 0
    # A batch that is written again replaces itself.
    write_delta(batch, path, 0)
    write_delta(batch, path, 0)
    again = merge_on_read(spark, path).drop("tags")
    assert again.exceptAll(expected).count() == 0 and again.count() == expected.count()
    may = merge_on_read(spark, path, [dt.date(2024, 5, 1)])
    assert may.count() == 0
    assert fold(batch, "seq").count() == expected.count()


def test_one_firing_alert_across_batches(spark, tmp_path):
    schema = "tenant_id string, budget_id string, aws_account_id string, state string, seq int"
    src = str(tmp_path / "src")
    os.mkdir(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for batch in ([("t", "b", "1", "firing", 1), ("t", None, "1", "firing", 2)], [("t", "b", "2", "firing", 3), ("u", "b", "1", "firing", 4), ("t", None, "1", "firing", 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        S.stream_alert_dedup(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    got = sorted(map(str, ((r.tenant_id, r.budget_id, r.aws_account_id) for r in stored.collect())))
    assert got == sorted(map(str, [("t", "b", "1"), ("u", "b", "1"), ("t", None, "1"), ("t", None, "1")]))


def test_hourly_spikes(spark):
    start = dt.datetime(2026, 1, 1)
    hours = [("t", "1", start + dt.timedelta(hours=i), Decimal(1 if i < 24 * 90 else 4)) for i in range(24 * 97)]
    df = spark.createDataFrame(hours, "tenant_id string, aws_account_id string, hour timestamp_ntz, total_usd decimal(28,6)")
    got = S.hourly_spikes(df)
    last = got.orderBy(F.col("hour").desc()).first()
    assert last.percent_change == 300.0 and last.current_usd == 4 * 168 and last.baseline_usd == 2160


def test_change_sessions_stream_equals_batch(spark, tmp_path):
    schema = "aws_account_id string, change_id int, changed_at timestamp_ntz"
    t = lambda h, m: dt.datetime(2026, 6, 2, h, m)
    rows = [("1", 1, t(13, 45)), ("1", 2, t(13, 45)), ("1", 3, t(14, 10)), ("1", 4, t(15, 0)), ("2", 5, t(14, 0))]
    batch = change_sessions(spark.createDataFrame(rows, schema))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    far = [("9", 9, dt.datetime(2030, 1, 1))]
    for r in (rows, far):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(src)
    stream = S.stream_change_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).select(*batch.columns)
    assert got.count() == 3 and got.exceptAll(batch).count() == 0


def test_event_time_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 6, 1, 23, 30),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            day = S.event_time(df, "ts").select(S.utc_wall(F.window("ts", "1 day")["start"]).cast("string")).first()[0]
            assert day == "2026-06-01 00:00:00", z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def files(spark, path, schema, *parts):
    """One file for each part, the oldest first, as a stream of one file a batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ALERTS = "tenant_id string, budget_id string, state string, no int, seq bigint"


def plain_changes(rows):
    """State of a budget by a plain loop over alerts in order."""
    firing, kept = set(), []
    for tenant, budget, state, no, seq in sorted(rows, key=lambda r: (r[4], r[2] != "firing")):
        key = (tenant, budget)
        if tenant is None or budget is None:
            kept.append(no)
        elif (state == "firing") != (key in firing):
            kept.append(no)
            (firing.add if state == "firing" else firing.discard)(key)
    return sorted(kept), firing


def test_a_budget_fires_again_after_it_was_resolved(spark, tmp_path):
    rnd = random.Random(7)
    budgets = ["hot"] * 4 + ["b", "c", None]
    # Sparse numbers; one budget holds more than half of the alerts.
    rows = [(rnd.choice(["t", "t", "u", None]), rnd.choice(budgets), rnd.choice(["firing", "firing", "resolved", "acknowledged", None]), i, i * 977) for i in range(900)]
    stream = files(spark, str(tmp_path / "src"), ALERTS, rows[:300], rows[300:310], rows[310:])
    S.stream_alert_changes(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    kept, firing = plain_changes(rows)
    assert sorted(r.no for r in spark.read.parquet(str(tmp_path / "t")).collect()) == kept
    left = carried(spark, f"{tmp_path}/t/_open", S.OPEN_KEYS, 3).collect()
    assert sorted((r.tenant_id, r.budget_id) for r in left) == sorted(firing)


def test_a_batch_of_alerts_reads_open_keys_only_and_can_be_repeated(spark, tmp_path):
    path, empty = str(tmp_path / "k"), spark.createDataFrame([], S.OPEN_KEYS)
    first = spark.createDataFrame([("t", "b", "firing", 1, 1), ("t", "c", "firing", 2, 2), ("t", "c", "resolved", 3, 3)], ALERTS)
    rows, still = alert_changes(first, empty)
    assert sorted(r.no for r in rows.collect()) == [1, 2, 3]
    carry(still, path, 0)
    second = spark.createDataFrame([("t", "b", "firing", 4, 4), ("t", "c", "firing", 5, 5)], ALERTS)
    for _ in range(2):  # a batch that is run again finds what the one before left
        rows, still = alert_changes(second, carried(spark, path, S.OPEN_KEYS, 1))
        assert [r.no for r in rows.collect()] == [5]
        assert rows.columns == ["tenant_id", "budget_id", "state", "no"]
        carry(still, path, 1)
    assert sorted(r.budget_id for r in carried(spark, path, S.OPEN_KEYS, 2).collect()) == ["b", "c"]
    rows, still = alert_changes(spark.createDataFrame([], ALERTS), carried(spark, path, S.OPEN_KEYS, 2))
    assert rows.count() == 0 and still.count() == 2


def test_final_days_count_what_came_too_late(spark, tmp_path):
    far = ("t", "s", dt.datetime(2030, 1, 1), Decimal(1))
    stream = files(
        spark, str(tmp_path / "src"), SCHEMA,
        [line(1, 10), line(30, 5)], [line(2, 3), line(31, 1, month=7)], [line(31, 2, month=7)], [line(29, 7), line(1, 100), line(1, 50)], [far],
    )
    counts = S.stream_daily_final(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "t")).collect()
    got = {r.date: (int(r.total_usd), r.lines) for r in rows}
    day = lambda m, d: dt.date(2026, m, d)
    assert len(rows) == len(got) and got == {day(6, 1): (10, 1), day(6, 2): (3, 1), day(6, 29): (7, 1), day(6, 30): (5, 1), day(7, 31): (3, 2)}
    assert counts["read"] - counts["stored"] - 1 == 2 and counts["late_sums"] == 1


HOURS = "tenant_id string, aws_account_id string, ts timestamp_ntz, cost_usd decimal(18,6)"


def test_streamed_spikes_equal_the_batch_and_keep_a_bounded_state(spark, tmp_path):
    rnd = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    rows = [
        (t, a, start + dt.timedelta(hours=h, minutes=rnd.randrange(60)), Decimal(rnd.randrange(1, 9) * (4 if h // 100 % 4 == 3 else 1)))
        for t, a in (("t", "1"), ("t", None), ("u", "2")) for h in range(0, 900, 1 if a else 7) if (a != "2" or not 300 < h < 420)
    ]
    rows.sort(key=lambda r: r[2])
    cut = len(rows) // 4
    mixed = rows[:]
    mixed[cut - 5:cut + 5] = reversed(mixed[cut - 5:cut + 5])  # some come late
    far = ("t", "9", dt.datetime(2030, 1, 1), Decimal(1))
    parts = [mixed[i * cut:(i + 1) * cut] for i in range(3)] + [mixed[3 * cut:], [far]]
    stream = files(spark, str(tmp_path / "src"), HOURS, *parts)
    days = {"current_days": 2, "baseline_days": 6}
    S.stream_spikes(stream, str(tmp_path / "t"), str(tmp_path / "c"), late="1 day", **days)
    table = spark.createDataFrame(rows, HOURS)
    hourly = table.groupBy("tenant_id", "aws_account_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("cost_usd").cast("decimal(28,6)").alias("total_usd"))
    expected = S.hourly_spikes(hourly, **days)
    got = spark.read.parquet(str(tmp_path / "t")).select(*expected.columns)
    assert got.count() == expected.count() > 0
    assert got.exceptAll(expected).count() == 0
    last = max(int(d.split("=")[1]) for d in os.listdir(tmp_path / "t") if d.startswith("batch_id"))
    schema = "tenant_id string, aws_account_id string, hour timestamp_ntz, total_usd decimal(28,6), hour_no bigint"
    kept = carried(spark, f"{tmp_path}/t/_panes", spark.createDataFrame([], schema).schema, last + 1)
    lo, hi = kept.agg(F.min("hour_no"), F.max("hour_no")).first()
    assert hi - lo < 8 * 24 and kept.groupBy("tenant_id", "aws_account_id").count().agg(F.max("count")).first()[0] <= 8 * 24


def test_reads_open_the_base_and_later_batches_only(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    records = event_records(sample.table(spark, sf_dir, "events")).where("seq < 400")
    for i in range(8):
        write_delta(records.where(F.col("seq") % 8 == i), path, i)
    expected = upsert_cost_records(records.limit(0).drop("seq"), records).drop("tags")

    def same():
        got = merge_on_read(spark, path).drop("tags")
        assert got.count() == expected.count() > 0 and got.exceptAll(expected).count() == 0

    compact_log(spark, path, 3)
    same()
    # A run that stopped before its base was named changes nothing, nor does a batch that was folded and is written again.
    fold(records, "seq").withColumn("month", F.trunc("date", "MM")).write.partitionBy("month").parquet(f"{path}/_base-stopped")
    write_delta(records.where(F.col("seq") % 8 == 2), path, 2)
    same()
    compact_log(spark, path, 6)
    compact_log(spark, path, 5)  # nothing left to do
    same()
    opened = [r.f for r in _log(spark, path).select(F.input_file_name().alias("f")).distinct().collect()]
    assert opened and all("/_base-" in f or "/batch_id=7/" in f for f in opened)
    assert len({f.split("/_base-")[1][:12] for f in opened if "/_base-" in f}) == 1
    assert merge_on_read(spark, path, [dt.date(2024, 5, 1)]).count() == 0
    write_delta(records.where(F.col("seq") % 8 == 0), path, 8)
    same()


def test_views_follow_three_syncs_without_the_facts(spark, sf_dir, tmp_path):
    log, cells = str(tmp_path / "log"), str(tmp_path / "cells")
    records = event_records(sample.table(spark, sf_dir, "events")).withColumn("account_alias", F.lit("a")).where("seq < 600")
    # The last sync brings a row that counts before the others, so a record moves to another service; one batch is empty.
    early = records.where("seq = 300").withColumns({"seq": F.lit(-1).cast("bigint"), "service": F.lit("moved")})
    parts = [records.where("seq % 2 = 0"), records.where("seq % 2 = 1"), records.limit(0), early]
    for i, part in enumerate(parts):
        for _ in range(2 if i in (1, 3) else 1):  # run again after it was stored
            write_delta(part, log, i)
            update_view_cells(spark, log, cells, i)
    facts, kept = merge_on_read(spark, log), view_cells(spark, cells)
    assert facts.where("service = 'moved'").count() == 1
    for view in (costs.monthly_spend_view, costs.daily_spend_view, lambda f: costs.top_services_this_month_view(f, "2024-01-20")):
        expected, got = view(facts), view(kept)
        assert got.count() == expected.count() > 0 and got.exceptAll(expected).count() == 0
    month = costs.top_services_this_month_view(kept, "2024-02-20")
    text = month._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", text)
