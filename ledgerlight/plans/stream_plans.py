"""Streams over the event table. Each run processes all files that are there and
returns the resulting table."""

from pyspark.sql import functions as F

from ..operators.costs import monthly_spend_view
from ..schemas import COST_RECORDS
from ..sinks import merge_on_read, run_dir, view_cells
from ..sources import sample
from ..streaming import streams as S
from .registry import query
from .views import event_account, event_tenant


FILES = 4


def event_stream(spark, sf):
    """The event table as a stream of ``FILES`` files in the order of event ids, one file a micro-batch."""
    events = sample.table(spark, sf, "events")
    folder = run_dir(spark, "events")
    events.repartitionByRange(FILES, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def event_records(ev):
    """Events as restated cost records of their account, day, type and region; later
    events (by id) replace the cost."""
    lines = sample.event_lines(ev).withColumns(
        {
            "id": F.substring(
                F.sha2(F.concat_ws(":", "aws_account_id", F.col("date").cast("string"), "service", "region"), 256), 1, 20
            ),
            "account_alias": F.concat(F.lit("event-"), F.col("event_id").cast("string")),
            "granularity": F.lit("DAILY"),
            "provider": F.lit("aws"),
            "service_group": F.lit("other"),
            "usage_quantity": F.lit(1),
            "usage_unit": F.lit(""),
            "tags": F.expr("cast(map() as map<string,string>)"),
            "ingested_at": F.col("ts"),
            "raw_service_name": F.col("service"),
            "created_at": F.col("ts"),
            "seq": F.col("event_id"),
        }
    )
    return lines.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COST_RECORDS.fields], "seq")


def later_files(spark, parts):
    """The parts as a stream of one file each, in this order."""
    folder = run_dir(spark, "parts")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def in_order(ev):
    """Four parts of the events, cut by their ids."""
    n = F.col("event_id")
    cuts = ev.agg(F.percentile_approx(n, [0.25, 0.5, 0.75]).alias("c")).first().c or [0, 0, 0]
    return [ev.where(n <= cuts[0]), *[ev.where((n > lo) & (n <= hi)) for lo, hi in zip(cuts, cuts[1:])], ev.where(n > cuts[-1])]


def closing_row(ev):
    """One row far behind the newest, so that every hour and day before it closes."""
    return ev.groupBy().agg(F.max(F.struct("ts", *[c for c in ev.columns if c != "ts"])).alias("r")).select(
        *[(F.col("r.ts") + F.expr("interval 400 days")).alias("ts") if c == "ts" else F.col(f"r.{c}") for c in ev.columns]
    )


DAILY_SQL = "SELECT tenant_id, service, date, cast(sum(cost_usd) AS DECIMAL(28,6)) AS total_usd FROM tagged_lines GROUP BY 1, 2, 3"


@query("stream_daily_spend", DAILY_SQL)
def stream_daily_spend(spark, sf):
    agg = S.stream_daily_spend(sample.event_lines(event_stream(spark, sf)))
    out = run_dir(spark, "daily-spend")
    S.run_updates(agg, f"{out}/table", f"{out}/checkpoint")
    return S.latest_updates(spark, f"{out}/table", agg.schema, ["date", "tenant_id", "service"])


REGION = "['us-east-1', 'us-west-2', 'eu-west-1'][1 + user_id % 3]"


@query(
    "stream_daily_final",
    """SELECT tenant_id, service, date, cast(sum(cost_usd) AS DECIMAL(28,6)) AS total_usd, count(*) AS lines,
  (SELECT count(*) FROM events WHERE event_id % 50 = 7) AS dropped FROM tagged_lines GROUP BY 1, 2, 3""",
)
def stream_daily_final(spark, sf):
    """Days are stored once, when they close. Every tenth event comes after the others, still in time; copies of every
    fiftieth, dated a hundred days back, come too late; a last row closes all days."""
    ev = sample.table(spark, sf, "events")
    back = (F.col("ts") - F.expr("interval 100 days")).alias("ts")
    too_late = ev.where("event_id % 50 = 7").select(*[back if c == "ts" else c for c in ev.columns])
    stream = later_files(spark, [ev.where("event_id % 10 != 3"), ev.where("event_id % 10 = 3"), too_late, closing_row(ev)])
    out = run_dir(spark, "daily-final")
    counts = S.stream_daily_final(sample.event_lines(stream), f"{out}/table", f"{out}/checkpoint")
    dropped = counts["read"] - counts["stored"] - 1  # but for the closing row, whose day stays open
    stored = spark.read.schema("date date, tenant_id string, service string, total_usd decimal(28,6), lines bigint").parquet(f"{out}/table")
    return stored.drop("batch_id").withColumn("dropped", F.lit(dropped).cast("bigint"))


UPSERT_SQL = (
    f"""SELECT id, arg_min(alias, event_id) AS account_alias, arg_max(cost, event_id) AS cost_usd, arg_max(ts, event_id) AS ingested_at,
  min(ts) FILTER (WHERE event_id = first) AS created_at
FROM (SELECT *, min(event_id) OVER (PARTITION BY id) AS first FROM (
  SELECT event_id, ts, cast(value AS DECIMAL(18,6)) AS cost, 'event-' || event_id AS alias,
  substr(sha256(concat_ws(':', {event_account()}, cast(cast(ts AS DATE) AS VARCHAR), event_type, {REGION})), 1, 20) AS id FROM events))
GROUP BY id"""
)


@query("stream_upsert_cost", UPSERT_SQL)
def stream_upsert_cost(spark, sf):
    out = run_dir(spark, "upsert")
    S.stream_upsert_cost(event_records(event_stream(spark, sf)), f"{out}/table", f"{out}/checkpoint")
    return merge_on_read(spark, f"{out}/table").select("id", "account_alias", "cost_usd", "ingested_at", "created_at")


@query("stream_upsert_compacted", UPSERT_SQL)
def stream_upsert_compacted(spark, sf):
    """The same, with the batches before folded into a base every second batch."""
    out = run_dir(spark, "upsert")
    S.stream_upsert_cost(event_records(event_stream(spark, sf)), f"{out}/table", f"{out}/checkpoint", compact_every=2)
    return merge_on_read(spark, f"{out}/table").select("id", "account_alias", "cost_usd", "ingested_at", "created_at")


@query(
    "stream_monthly_spend_view",
    f"""SELECT tenant_id, aws_account_id, 'all' AS account_alias, cast(date_trunc('month', date) AS DATE) AS month, 'other' AS service_group,
  cast(sum(cost) AS DECIMAL(28,6)) AS total_usd, count(DISTINCT event_type) AS service_count
FROM (SELECT {event_tenant()} AS tenant_id, {event_account()} AS aws_account_id, cast(ts AS DATE) AS date, event_type, {REGION} AS region,
    arg_max(cast(value AS DECIMAL(18,6)), event_id) AS cost FROM events GROUP BY ALL) GROUP BY 1, 2, 4""",
)
def stream_monthly_spend_view(spark, sf):
    """The monthly view over sums that followed each batch of restated records; the facts are not read for it."""
    out = run_dir(spark, "views")
    records = event_records(event_stream(spark, sf)).withColumn("account_alias", F.lit("all"))
    S.stream_upsert_cost(records, f"{out}/table", f"{out}/checkpoint", compact_every=2, views_path=f"{out}/cells")
    return monthly_spend_view(view_cells(spark, f"{out}/cells"))


def event_alerts(ev):
    """Every event as an alert on its user's budget; clicks belong to no budget."""
    return ev.selectExpr(
        f"{sample.TENANT_OF_USER} AS tenant_id",
        "CASE WHEN event_type != 'click' THEN concat('b-', user_id) END AS budget_id",
        f"{sample.ACCOUNT_OF_USER} AS aws_account_id",
        "'firing' AS state",
        "event_id AS seq",
    )


@query(
    "stream_alert_dedup",
    f"""SELECT tenant_id, budget_id, 1 AS alerts, arg_min(account, event_id) AS aws_account_id FROM (
SELECT {event_tenant()} AS tenant_id, 'b-' || user_id AS budget_id, {event_account()} AS account, event_id FROM events WHERE event_type <> 'click') GROUP BY 1, 2
UNION ALL SELECT tenant_id, NULL, count(*), NULL FROM (SELECT {event_tenant()} AS tenant_id FROM events WHERE event_type = 'click') GROUP BY 1""",
)
def stream_alert_dedup(spark, sf):
    out = run_dir(spark, "alerts")
    S.stream_alert_dedup(event_alerts(event_stream(spark, sf)), f"{out}/table", f"{out}/checkpoint")
    stored = spark.read.schema("tenant_id string, budget_id string, aws_account_id string, state string").parquet(f"{out}/table")
    account = F.when(F.col("budget_id").isNotNull(), F.max("aws_account_id"))
    return stored.groupBy("tenant_id", "budget_id").agg(F.count("*").alias("alerts"), account.alias("aws_account_id"))


@query(
    "stream_hourly_spikes",
    """SELECT tenant_id, aws_account_id, hour, cast(cur AS DECIMAL(28,6)) AS current_usd, cast(base AS DECIMAL(28,6)) AS baseline_usd,
  round((cur::DOUBLE / 48 - base::DOUBLE / 240) / (base::DOUBLE / 240) * 100, 2) AS percent_change
FROM (SELECT h.tenant_id, h.aws_account_id, h.hour, sum(o.t) FILTER (WHERE o.hour > h.hour - INTERVAL 48 HOUR) AS cur,
    sum(o.t) FILTER (WHERE o.hour <= h.hour - INTERVAL 48 HOUR) AS base, min(o.hour) AS oldest
  FROM (SELECT tenant_id, aws_account_id, date_trunc('hour', ts) AS hour, sum(cost_usd) AS t FROM tagged_lines GROUP BY ALL) h
  JOIN (SELECT tenant_id, aws_account_id, date_trunc('hour', ts) AS hour, sum(cost_usd) AS t FROM tagged_lines GROUP BY ALL) o
    ON o.tenant_id = h.tenant_id AND o.aws_account_id = h.aws_account_id AND o.hour <= h.hour AND o.hour > h.hour - INTERVAL 288 HOUR
  GROUP BY ALL)
WHERE base > 0 AND oldest <= hour - INTERVAL 168 HOUR AND (cur::DOUBLE / 48 - base::DOUBLE / 240) / (base::DOUBLE / 240) * 100 > 50""",
)
def stream_hourly_spikes(spark, sf):
    """Two days against the ten before them, as the table holds one month."""
    agg = S.stream_hourly_spend(sample.event_lines(event_stream(spark, sf)))
    out = run_dir(spark, "hourly")
    S.run_updates(agg, f"{out}/table", f"{out}/checkpoint")
    hourly = S.latest_updates(spark, f"{out}/table", agg.schema, ["hour", "tenant_id", "aws_account_id"])
    return S.hourly_spikes(hourly, current_days=2, baseline_days=10)


@query(
    "stream_alert_changes",
    f"""SELECT tenant_id, budget_id, event_id AS no, state FROM (
  SELECT *, coalesce(lag(state) OVER (PARTITION BY tenant_id, budget_id ORDER BY event_id), 'resolved') AS before FROM (
    SELECT {event_tenant()} AS tenant_id, 'b-' || user_id AS budget_id, event_id,
      CASE WHEN event_type IN ('purchase', 'view') THEN 'resolved' ELSE 'firing' END AS state
    FROM events WHERE event_type <> 'click')) WHERE state <> before
UNION ALL SELECT {event_tenant()}, NULL, event_id, 'firing' FROM events WHERE event_type = 'click'""",
)
def stream_alert_changes(spark, sf):
    """Purchases and views resolve the budget of their user, other events fire it."""
    state = "CASE WHEN event_type IN ('purchase', 'view') THEN 'resolved' ELSE 'firing' END AS state"
    budget = "CASE WHEN event_type != 'click' THEN concat('b-', user_id) END AS budget_id"
    stream = later_files(spark, in_order(sample.table(spark, sf, "events")))
    alerts = stream.selectExpr(f"{sample.TENANT_OF_USER} AS tenant_id", budget, "event_id AS no", state, "event_id AS seq")
    out = run_dir(spark, "alert-changes")
    S.stream_alert_changes(alerts, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema("tenant_id string, budget_id string, no bigint, state string").parquet(f"{out}/table").drop("batch_id")


@query(
    "stream_spikes",
    """WITH h AS (SELECT tenant_id, aws_account_id, date_trunc('hour', TIMESTAMP '2024-01-01 00:00:00' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) * 5)) AS hour,
  sum(CASE WHEN day(ts) > 25 AND user_id % 3 = 0 THEN cost_usd * 3 ELSE cost_usd END) AS t
  FROM (SELECT l.*, e.user_id FROM tagged_lines l JOIN events e USING (event_id)) GROUP BY ALL)
SELECT tenant_id, aws_account_id, hour, cast(cur AS DECIMAL(28,6)) AS current_usd, cast(base AS DECIMAL(28,6)) AS baseline_usd,
  round((cur::DOUBLE / 168 - base::DOUBLE / 2160) / (base::DOUBLE / 2160) * 100, 2) AS percent_change
FROM (SELECT h.tenant_id, h.aws_account_id, h.hour, sum(o.t) FILTER (WHERE o.hour > h.hour - INTERVAL 168 HOUR) AS cur,
    sum(o.t) FILTER (WHERE o.hour <= h.hour - INTERVAL 168 HOUR) AS base, min(o.hour) AS oldest
  FROM h JOIN h o ON o.tenant_id = h.tenant_id AND o.aws_account_id = h.aws_account_id AND o.hour <= h.hour AND o.hour > h.hour - INTERVAL 2328 HOUR
  GROUP BY ALL)
WHERE base > 0 AND oldest <= hour - INTERVAL 1248 HOUR AND (cur::DOUBLE / 168 - base::DOUBLE / 2160) / (base::DOUBLE / 2160) * 100 > 50""",
)
def stream_spikes(spark, sf):
    """Seven days against the ninety before, batch by batch. The month of events is stretched to 150 days, and a third of
    the users spend three times as much in its last days."""
    ev = sample.table(spark, sf, "events")
    start = "unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' AS timestamp))"
    slow = f"cast(timestamp_micros({start} + (unix_micros(cast(ts AS timestamp)) - {start}) * 5) AS timestamp_ntz)"
    more = "CASE WHEN day(ts) > 25 AND user_id % 3 = 0 THEN value * 3 ELSE value END"
    long = ev.withColumns({"value": F.expr(more), "ts": F.expr(slow)})
    out = run_dir(spark, "spikes")
    lines = sample.event_lines(later_files(spark, [*in_order(long), closing_row(long)]))
    S.stream_spikes(lines, f"{out}/table", f"{out}/checkpoint", late="2 days")
    schema = "tenant_id string, aws_account_id string, hour timestamp_ntz, current_usd decimal(28,6), baseline_usd decimal(28,6), percent_change double"
    return spark.read.schema(schema).parquet(f"{out}/table").drop("batch_id")
