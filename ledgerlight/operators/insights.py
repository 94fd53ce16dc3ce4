"""The monitoring answer: overview, gate and recommendations of every tenant in one row, and storing what it recommends."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import validate_days
from ..sinks.store import append_table, materialise
from ..sinks.tables import recommendation_rows
from . import recommend as RE
from . import rollups as R

RECOMMENDATION = [
    "rank", "aws_account_id", "recommendation_type", "title", "description", "priority", "estimated_savings_monthly_usd",
    "confidence_score", "action_steps",
]


def monitoring_insights(
    costs: DataFrame, inventory: DataFrame, as_of, days: int = 30, tenant_id=None, aws_account_id=None, tenants=None,
    n: int = RE.TOP_N,
) -> DataFrame:
    """One row per tenant: whether there is anything to report, the overview, and the ``n`` best recommendations.

    A tenant without spend and resources has ``success`` false and an empty list, as has one that nothing is recommended
    to, with ``success`` true. A failed read raises. The inventory and the recommendations are written once, since the
    overview, the three kinds of recommendation and the terciles read them; what is gathered is bounded by ``n``.
    """
    stock = materialise(inventory, "inventory")
    overview = R.build_overview(costs, stock, as_of, validate_days(days), tenant_id, aws_account_id, tenants)
    recs = materialise(RE.all_recommendations(costs, stock, as_of, tenant_id, aws_account_id), "recommendations")
    best = RE.top_recommendations(recs, n).groupBy("tenant_id").agg(
        F.array_sort(F.collect_list(F.struct(*RECOMMENDATION))).alias("recommendations")
    )
    none = F.array().cast(best.schema["recommendations"].dataType)
    rows = overview.join(best, "tenant_id", "left")
    success, message = R.gate(F.col("total_usd"), F.col("total_resource_types"))
    return rows.select(
        "tenant_id", success.alias("success"), message.alias("message"),
        *[c for c in overview.columns if c != "tenant_id"],
        F.when(success, F.coalesce("recommendations", none)).otherwise(none).alias("recommendations"),
    )


def store_recommendations(insights: DataFrame, path: str, batch_id: int, created_at: Column) -> None:
    """Store what the insights recommend as rows of the recommendation table. A run that is repeated under its batch id
    replaces what it stored."""
    rows = insights.select("tenant_id", F.inline("recommendations")).drop("rank")
    append_table(recommendation_rows(rows, created_at), path, batch_id)
