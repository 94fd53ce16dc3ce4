"""Root causes: changes near an anomaly, and what a spend delta is made of."""

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..functions.dates import days_before
from ..schemas import TOTAL
from ..sources.tables import scoped

OPEN_HOURS = 24
WIDTHS = [1, 16, 256, 4096]  # hours of the pieces that a time span is cut into


def hour_of(ts):
    """Hours since 1970 of a wall-clock time."""
    return (F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("bigint")


def span_pieces(first, last):
    """The hours ``first`` to ``last`` as pieces ``(level, piece)``, piece number p of level l being the hours from
    ``p * WIDTHS[l]`` on. Larger pieces fill the middle and smaller ones the ends, so a year has under 100 pieces; each hour lies in exactly one."""
    pieces, lo, hi = [], first, last + 1
    for level, width in enumerate(WIDTHS):
        def run(start, stop):
            n = F.greatest(F.floor((stop - start) / width), F.lit(0))
            steps = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))))
            numbers = F.coalesce(steps, F.array().cast("array<bigint>"))
            at = F.floor(start / width)
            return F.transform(numbers, lambda i: F.struct(F.lit(level).alias("level"), (at + i).alias("piece")))

        if level + 1 == len(WIDTHS):
            pieces.append(run(lo, hi))
            break
        wider = WIDTHS[level + 1]
        up, down = F.ceil(lo / wider) * wider, F.floor(hi / wider) * wider
        middle = up < down
        pieces += [run(lo, F.when(middle, up).otherwise(hi)), run(down, F.when(middle, hi).otherwise(down))]
        lo, hi = F.when(middle, up).otherwise(hi), F.when(middle, down).otherwise(hi)
    return F.concat(*pieces)


def change_pairs(anomalies: DataFrame, changes: DataFrame, lead_minutes: int = 60, as_of=None) -> DataFrame:
    """Changes of the same account between ``lead_minutes`` before an anomaly and its end.

    An anomaly that has no end yet is open until ``as_of``, or for a day after its start where that isn't given.

    A range join through pieces of time: an anomaly is copied to the few pieces of growing length that its span is cut
    into, a change lies in one piece of each of the four lengths, so every pair meets exactly once on the equi key
    (account, level, piece), however long the anomaly is open. A busy account is spread over its pieces.
    """
    lead = F.expr(f"interval {int(lead_minutes)} minutes")
    by_now = F.lit(None) if as_of is None else F.lit(str(as_of))
    until = F.greatest("start_at", F.coalesce(by_now.cast("timestamp_ntz"), F.col("start_at") + F.expr(f"interval {OPEN_HOURS} hours")))
    hours = anomalies.withColumn("end_at", F.coalesce("end_at", until)).withColumns(
        {"a_from": hour_of(F.col("start_at") - lead), "a_to": hour_of(F.col("end_at"))}
    )
    spans = hours.select(
        "anomaly_id", F.col("aws_account_id").alias("a_account"), "start_at", "end_at",
        F.inline(span_pieces(F.col("a_from"), F.col("a_to"))),
    )
    lies_in = F.array(*[
        F.struct(F.lit(level).alias("c_level"), F.floor(F.col("c_hour") / width).alias("c_piece")) for level, width in enumerate(WIDTHS)
    ])
    dated = changes.withColumn("c_hour", hour_of(F.col("changed_at"))).select(*changes.columns, F.inline(lies_in))
    pairs = spans.join(
        dated,
        (F.col("a_account") == F.col("aws_account_id")) & (F.col("level") == F.col("c_level")) & (F.col("piece") == F.col("c_piece")),
    )
    near = pairs.where((F.col("changed_at") >= F.col("start_at") - lead) & (F.col("changed_at") <= F.col("end_at")))
    lag_seconds = F.unix_micros(F.col("start_at").cast("timestamp")) - F.unix_micros(F.col("changed_at").cast("timestamp"))
    return near.select(
        "anomaly_id", "aws_account_id", "change_id", "resource_id", "action", "changed_at",
        F.floor(lag_seconds / 60_000_000).cast("bigint").alias("lag_minutes"),
    )


def rca_change_correlation(anomalies: DataFrame, changes: DataFrame, lead_minutes: int = 60, as_of=None, top: int | None = None) -> DataFrame:
    """Every candidate change of every anomaly, ranked by closeness to its start.

    ``lag_minutes`` is positive before the start. Changes in the same minute share a
    rank. Ranks come from counts per minute, whose number is bounded by the window,
    so an anomaly with very many changes is not sorted in one task.

    With ``top`` only so many changes of an anomaly are returned, of the same minute those of smaller ``change_id``; each
    task passes on no more than that of an anomaly.
    """
    pairs = change_pairs(anomalies, changes, lead_minutes, as_of).withColumn("distance", F.abs("lag_minutes"))
    if top is not None:
        closest = Window.partitionBy("anomaly_id").orderBy("distance", "change_id")
        kept = pairs.withColumn("n", F.row_number().over(closest)).where(F.col("n") <= int(top)).drop("n")
        rank = F.rank().over(Window.partitionBy("anomaly_id").orderBy("distance"))
        return kept.withColumn("closeness_rank", rank.cast("bigint")).drop("distance")
    per_minute = pairs.groupBy("anomaly_id", "distance").agg(F.count("*").alias("c"))
    closer = Window.partitionBy("anomaly_id").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_minute.select(
        "anomaly_id", "distance",
        (F.coalesce(F.sum("c").over(closer), F.lit(0)) + 1).alias("closeness_rank"),
    )
    return pairs.join(ranks, ["anomaly_id", "distance"]).drop("distance")


def change_sessions(changes: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Bursts of changes per account: a burst ends when nothing happens for the gap.

    Changes are summed to minutes first, so the window over an account holds at most
    one row per minute however many changes there are. With a gap of at least a
    minute this does not move any boundary.
    """
    if gap_minutes < 1:
        raise ValueError("the gap must be at least one minute")
    gap = F.expr(f"interval {int(gap_minutes)} minutes")
    minutes = changes.groupBy("aws_account_id", F.date_trunc("minute", "changed_at").alias("minute")).agg(
        F.count("*").alias("c"), F.min("changed_at").alias("lo"), F.max("changed_at").alias("hi")
    )
    w = Window.partitionBy("aws_account_id").orderBy("minute")
    quiet = F.lag("hi").over(w)
    starts = minutes.withColumn("new", F.when(F.col("lo") < quiet + gap, 0).otherwise(1))
    numbered = starts.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("aws_account_id", "session").agg(
        F.min("lo").alias("started_at"), (F.max("hi") + gap).alias("ended_at"), F.sum("c").alias("changes")
    ).drop("session")


def rca_contribution(costs: DataFrame, as_of, window_days: int = 30, by=("service", "region"), tenant_id=None) -> DataFrame:
    """What each slice adds to the change of its account between two windows.

    ``by`` may name any column, e.g. an extracted tag. Sums first, then one row per
    slice; the account total is a second, tiny aggregation joined back.
    """
    start = days_before(as_of, window_days)
    rows = scoped(costs, tenant_id, None, "DAILY", days_before(start, window_days), as_of)
    current = F.col("date") >= F.lit(start)
    signed = rows.groupBy("tenant_id", "aws_account_id", *by).agg(
        F.coalesce(F.sum(F.when(current, F.col("cost_usd"))), F.lit(0)).cast(TOTAL).alias("current_usd"),
        F.coalesce(F.sum(F.when(~current, F.col("cost_usd"))), F.lit(0)).cast(TOTAL).alias("previous_usd"),
    )
    slices = signed.withColumn("delta_usd", (F.col("current_usd") - F.col("previous_usd")).cast(TOTAL))
    whole = slices.groupBy("tenant_id", "aws_account_id").agg(F.sum("delta_usd").cast(TOTAL).alias("account_delta_usd"))
    return slices.join(whole, ["tenant_id", "aws_account_id"]).select(
        "tenant_id", "aws_account_id", *by,
        money(F.col("current_usd")).alias("current_usd"),
        money(F.col("previous_usd")).alias("previous_usd"),
        money(F.col("delta_usd")).alias("delta_usd"),
        F.when(
            F.col("account_delta_usd") != 0,
            F.round(F.col("delta_usd").cast("double") / F.col("account_delta_usd").cast("double") * 100, 4),
        ).alias("share_pct"),
    )


def rca_joint_split(
    costs: DataFrame, as_of, window_days: int = 30, by=("service", "region"), part_pct: int = 80, most: int | None = 20, tenant_id=None
) -> DataFrame:
    """The smallest set of slices of one grouping that explains ``part_pct`` percent of the change of an account.

    The groupings are all non-empty subsets of ``by``. The slices of a grouping don't overlap, so their shares add up, and
    the largest first reach the part with the fewest. Of groupings that need equally few, the one of fewer columns is
    taken (a slice is rolled up where that explains as much), then the one that explains more, then the one that
    names earlier columns of ``by``. Slices that moved against the account are in no set.

    Columns that are rolled up are null, and ``grouping`` names the others. Accounts without a change have no rows, nor
    have those where more than ``most`` slices are needed in every grouping; None sets no such limit. With one, a task
    passes on no more than ``most`` slices of a grouping.
    """
    start = days_before(as_of, window_days)
    rows = scoped(costs, tenant_id, None, "DAILY", days_before(start, window_days), as_of)
    account = ["tenant_id", "aws_account_id"]
    signed = F.when(F.col("date") >= F.lit(start), F.col("cost_usd")).otherwise(-F.col("cost_usd"))
    slices = rows.groupBy(*account, *by).agg(F.sum(signed).cast(TOTAL).alias("delta_usd"))
    whole = slices.groupBy(*account).agg(F.sum("delta_usd").cast(TOTAL).alias("account_delta_usd")).where("account_delta_usd <> 0")
    groupings = [c for n in range(1, len(by) + 1) for c in itertools.combinations(by, n)]
    keys = [*account, *by]
    cells = slices.groupingSets([[*account, *g] for g in groupings], *keys).agg(
        F.grouping_id(*keys).cast("int").alias("gid"), F.sum("delta_usd").cast(TOTAL).alias("delta_usd")
    )
    moved = cells.join(whole, account)
    gain = F.when(F.col("account_delta_usd") > 0, F.col("delta_usd")).otherwise(-F.col("delta_usd"))
    moved = moved.withColumn("gain", gain).where("gain > 0")
    order = [F.col("gain").desc(), *[F.col(c).asc_nulls_first() for c in by]]
    largest = Window.partitionBy(*account, "gid").orderBy(*order)
    ranked = moved.withColumn("rank", F.row_number().over(largest))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= int(most))
    so_far = F.sum("gain").over(largest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = F.abs("account_delta_usd") * int(part_pct)
    needed = ranked.withColumn("reached", so_far).where((F.col("reached") - F.col("gain")) * 100 < asked)
    sets = needed.groupBy(*account, "gid", "account_delta_usd").agg(F.max("rank").alias("slices"), F.max("reached").alias("reached"))
    sets = sets.where(F.col("reached") * 100 >= asked)
    # A bit is set for each column that is rolled up.
    chosen = sets.groupBy(*account).agg(F.min(F.struct("slices", (-F.bit_count("gid")).alias("columns"), (-F.col("reached")).alias("less"), "gid")).alias("best"))
    chosen = chosen.select(*account, "best.gid", "best.slices", (-F.col("best.less")).alias("explained"))
    names = F.concat_ws(",", *[F.when(F.col("gid").bitwiseAND(1 << (len(by) - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(by)])

    def share(c):
        return F.round(F.col(c).cast("double") / F.abs("account_delta_usd").cast("double") * 100, 4)

    return needed.join(chosen, [*account, "gid"]).select(
        *account, names.alias("grouping"), "rank", *by, money(F.col("delta_usd")).alias("delta_usd"),
        share("gain").alias("share_pct"), share("reached").alias("cumulative_pct"), share("explained").alias("explained_pct"),
        "slices",
    )
