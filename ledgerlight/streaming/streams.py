"""Incremental variants: daily spend, cost upserts, alerts and hourly spikes.

All sinks are folders with one sub-folder per micro-batch, written in overwrite
mode. A batch that is retried after a lost executor or driver replaces itself, so
results are exactly once without any state outside checkpoint and table.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOTAL
from ..sinks.alerts import alert_changes, alert_dedup_append
from ..sinks.store import append_table, carried, carry
from ..sinks.upsert import compact_log, write_delta
from ..sinks.views import update_view_cells

LATE = "32 days"  # how long the provider restates costs


def run_available(stream: DataFrame, checkpoint: str, on_batch, mode: str = "append") -> list:
    """Process everything that is there, in as many batches as the source cuts, and stop. Returns the progress of each
    batch of this run, which is looked up as the batches go by, since a query remembers the last ones only."""
    running, progress = [], {}

    def look() -> None:
        for query in running:
            progress.update({p.batchId: p for p in query.recentProgress})

    def watched(df: DataFrame, batch_id: int) -> None:
        look()
        on_batch(df, batch_id)

    running.append(
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(watched)
        .start()
    )
    running[0].awaitTermination()
    look()
    return [progress[i] for i in sorted(progress)]


def staged(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The rows of a batch, written once, so that several jobs over them don't run the stream's plan again each."""
    carry(df, f"{path}/_batch", batch_id)
    return carried(df.sparkSession, f"{path}/_batch", df.schema, batch_id + 1)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Event time as an instant, as watermarks need one. A wall-clock column counts as UTC
    whatever the session's time zone is."""
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return df
    instant = F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())
    return df.withColumn(column, instant)


def utc_wall(instant):
    """UTC wall-clock time of an instant."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def stream_daily_spend(lines: DataFrame, keys=("tenant_id", "service"), late: str = LATE) -> DataFrame:
    """Spend per day and service of a stream with ``ts`` and ``cost_usd``.

    Rows up to 32 days late still count; older ones are dropped. State is one sum
    per open day and service, combined before the shuffle.
    """
    return (
        event_time(lines, "ts").withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), *keys)
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"))
        .select(utc_wall(F.col("w.start")).cast("date").alias("date"), *keys, "total_usd")
    )


def stream_daily_final(
    lines: DataFrame, path: str, checkpoint: str, keys=("tenant_id", "service"), late: str = LATE
) -> dict[str, int]:
    """Store each day once, when the watermark (``late`` behind the newest row) has passed its end.

    ``lines`` counts the rows of a sum. Rows of a day that was closed already are dropped; the result says how many rows
    this run read and stored in closed days and how many partial sums it dropped as late. Rows read, but neither stored
    nor in an open day, are the late ones.
    """
    name = "lines_read"
    read = event_time(lines, "ts").observe(name, F.count(F.lit(1)).alias("rows"))
    days = (
        read.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), *keys)
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"), F.count("*").alias("lines"))
        .select(utc_wall(F.col("w.start")).cast("date").alias("date"), *keys, "total_usd", "lines")
    )
    stored = 0

    def on_batch(df: DataFrame, batch_id: int) -> None:
        nonlocal stored
        closed = staged(df, path, batch_id)
        append_table(closed, path, batch_id)
        stored += closed.agg(F.sum("lines")).first()[0] or 0

    progress = run_available(days, checkpoint, on_batch)
    return {
        "read": sum(p.observedMetrics[name].rows for p in progress if name in p.observedMetrics),
        "stored": stored,
        "late_sums": sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators),
    }


def run_updates(agg: DataFrame, path: str, checkpoint: str) -> None:
    """Store the groups each batch changed."""

    def on_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_available(agg, checkpoint, on_batch, mode="update")


def latest_updates(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The newest version of every group."""
    full = T.StructType(list(schema.fields)).add("batch_id", T.LongType())
    rows = spark.read.schema(full).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


def stream_upsert_cost(
    records: DataFrame, path: str, checkpoint: str, seq: str = "seq", compact_every: int | None = None, views_path: str | None = None
) -> None:
    """Upsert a stream of cost records; read the result with ``merge_on_read``.

    With ``compact_every`` the batches before the current one are folded into a base each time so many have come. With
    ``views_path`` the sums under the spend views follow each batch; read them with ``view_cells``.
    """

    def on_batch(df: DataFrame, batch_id: int) -> None:
        write_delta(df, path, batch_id, seq)
        if views_path:
            update_view_cells(df.sparkSession, path, views_path, batch_id)
        if compact_every and batch_id and batch_id % compact_every == 0:
            compact_log(df.sparkSession, path, batch_id - 1)

    run_available(records, checkpoint, on_batch)


OPEN_KEYS = T.StructType().add("tenant_id", T.StringType()).add("budget_id", T.StringType())


def stream_alert_dedup(alerts: DataFrame, path: str, checkpoint: str, seq: str = "seq") -> None:
    """Store a stream of alerts with at most one firing alert per tenant and budget, whatever other states come.

    What is carried from batch to batch is one key for each budget that has fired, not the alerts. A retried batch
    finds the keys its predecessor left.
    """
    keys = f"{path}/_fired"

    def on_batch(df: DataFrame, batch_id: int) -> None:
        fired = carried(df.sparkSession, keys, OPEN_KEYS, batch_id)
        batch = staged(df, path, batch_id)
        append_table(alert_dedup_append(batch, fired.withColumn("state", F.lit("firing")), seq), path, batch_id)
        now = batch.where("budget_id IS NOT NULL AND state = 'firing'").select("tenant_id", "budget_id")
        carry(fired.union(now).distinct(), keys, batch_id)

    run_available(alerts, checkpoint, on_batch)


def stream_alert_changes(alerts: DataFrame, path: str, checkpoint: str, seq: str = "seq") -> None:
    """Store what changes the state of a budget: its first firing alert, its resolution, the next firing one.

    Each batch reads the keys that were firing after the one before (``alert_changes``), at most one for each budget.
    Batches count in the order they come in, the rows of a batch by ``seq``.
    """
    keys = f"{path}/_open"

    def on_batch(df: DataFrame, batch_id: int) -> None:
        before = carried(df.sparkSession, keys, OPEN_KEYS, batch_id)
        rows, still = alert_changes(staged(df, path, batch_id), before, seq)
        append_table(rows, path, batch_id)
        carry(still, keys, batch_id)

    run_available(alerts, checkpoint, on_batch)


def stream_hourly_spend(lines: DataFrame, keys=("tenant_id", "aws_account_id"), late: str = LATE) -> DataFrame:
    """Spend per hour. Sliding a 7-day window by the hour over raw rows would copy every
    row 168 times; hours are summed first and slid over afterwards."""
    return (
        event_time(lines, "ts").withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), *keys)
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"))
        .select(utc_wall(F.col("w.start")).alias("hour"), *keys, "total_usd")
    )


def hourly_spikes(
    hourly: DataFrame, keys=("tenant_id", "aws_account_id"), current_days: int = 7, baseline_days: int = 90,
    threshold_pct: float = 50,
) -> DataFrame:
    """Hours at which the last 7 days run more than 50 % above the days before them.

    Both windows slide by the hour over the hourly sums; a scope has at most one row
    per hour. Means are per calendar hour. A scope whose history reaches back over less
    than half of the baseline is still warming up and has no spikes.
    """
    return _spikes(hourly.withColumn("hour_no", hour_number("hour")), keys, current_days, baseline_days, threshold_pct)


def hour_number(hour) -> Column:
    return (F.date_diff(F.col(hour).cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour(hour)).cast("bigint")


def _spikes(rows: DataFrame, keys, current_days: int, baseline_days: int, threshold_pct: float, *carry_along: str) -> DataFrame:
    cur_h, base_h = current_days * 24, baseline_days * 24
    w = Window.partitionBy(*keys).orderBy("hour_no")
    current = F.sum("total_usd").over(w.rangeBetween(-(cur_h - 1), 0))
    base = F.sum("total_usd").over(w.rangeBetween(-(cur_h + base_h - 1), -cur_h))
    oldest = F.min("hour_no").over(w.rangeBetween(-(cur_h + base_h - 1), 0))
    sums = rows.withColumns({"current_usd": current.cast(TOTAL), "baseline_usd": base.cast(TOTAL), "oldest": oldest})
    sums = sums.where(F.col("oldest") <= F.col("hour_no") - cur_h - base_h // 2)
    cur_avg, base_avg = F.col("current_usd").cast("double") / cur_h, F.col("baseline_usd").cast("double") / base_h
    pct = (cur_avg - base_avg) / base_avg * 100
    return sums.where((F.col("baseline_usd") > 0)).where(pct > threshold_pct).select(
        *keys, "hour", "current_usd", "baseline_usd", F.round(pct, 2).alias("percent_change"), *carry_along
    )


def stream_spikes(
    lines: DataFrame, path: str, checkpoint: str, keys=("tenant_id", "aws_account_id"), current_days: int = 7,
    baseline_days: int = 90, threshold_pct: float = 50, late: str = LATE,
) -> None:
    """Hourly spikes as the stream goes: the batch in which an hour closes stores that hour's spikes, once and for all.

    An hour closes when the watermark, ``late`` behind the newest event, passes its end; later rows of it are dropped.
    What is carried are the closed hours of the last ``current_days + baseline_days`` days, so state and the window over
    a scope hold at most 2,328 hours (97 days) and what the batch closes. A scope's hours close in order, so no later
    batch can need a pane that was let go. The result equals ``hourly_spikes`` over all closed hours.
    """
    hourly = stream_hourly_spend(lines, keys, late)
    schema = T.StructType(list(hourly.schema.fields)).add("hour_no", T.LongType())
    span, panes = (current_days + baseline_days) * 24, f"{path}/_panes"

    def on_batch(df: DataFrame, batch_id: int) -> None:
        closed = staged(df.withColumn("hour_no", hour_number("hour")), path, batch_id)
        old = carried(df.sparkSession, panes, schema, batch_id)
        scopes = closed.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        touched = old.join(scopes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
        rows = closed.withColumn("fresh", F.lit(True)).unionByName(touched.withColumn("fresh", F.lit(False)))
        found = _spikes(rows, keys, current_days, baseline_days, threshold_pct, "fresh").where("fresh").drop("fresh")
        append_table(found, path, batch_id)
        every = old.unionByName(closed)
        newest = every.agg(F.max("hour_no")).first()[0]
        carry(every.where(F.col("hour_no") > F.lit(newest) + 1 - span), panes, batch_id)

    run_available(hourly, checkpoint, on_batch)


def stream_change_sessions(changes: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of resource changes per account: a session ends after a quiet gap."""
    return (
        event_time(changes, "changed_at").withWatermark("changed_at", late)
        .groupBy(F.session_window("changed_at", gap).alias("s"), "aws_account_id")
        .agg(F.count("*").alias("changes"))
        .select("aws_account_id", utc_wall(F.col("s.start")).alias("started_at"), utc_wall(F.col("s.end")).alias("ended_at"), "changes")
    )
