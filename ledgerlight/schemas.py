"""Declared schemas. Nothing is inferred at read time.

Money columns are wider than the narrowest type the data model needs:
``decimal(18, 6)`` still fits one machine word in Tungsten, and a hot
(account, day, service, region) cell cannot overflow it.
"""

from pyspark.sql import types as T

COST = "decimal(18,6)"
USAGE = "decimal(18,4)"
TOTAL = "decimal(28,6)"  # an unrounded sum of COST
WIDE = "decimal(38,12)"  # amounts before they are rounded, once, to their column
MONEY = "decimal(24,2)"  # a displayed amount
PERCENT = "decimal(18,2)"
AVERAGE = "decimal(24,4)"

STRING, DATE, STAMP = T.StringType(), T.DateType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields.items()])


COST_RECORDS = _struct(
    id=STRING, tenant_id=STRING, aws_account_id=STRING, account_alias=STRING, date=DATE, granularity=STRING,
    provider=STRING, service=STRING, service_group=STRING, region=STRING, cost_usd=T.DecimalType(18, 6),
    usage_quantity=T.DecimalType(18, 4), usage_unit=STRING, tags=T.MapType(STRING, STRING), ingested_at=STAMP,
    raw_service_name=STRING, created_at=STAMP,
)

ALERTS = _struct(
    tenant_id=STRING, budget_id=STRING, aws_account_id=STRING, alert_type=STRING, severity=STRING, title=STRING,
    message=STRING, current_value=T.DecimalType(24, 2), threshold_value=T.DecimalType(24, 2),
    percent_used=T.DecimalType(18, 1), state=STRING, triggered_at=STAMP,
)

# One page of the provider's nested cost feed. Amounts arrive as text.
_METRIC = _struct(Amount=STRING, Unit=STRING)
_GROUP = _struct(Keys=T.ArrayType(STRING), Metrics=T.MapType(STRING, _METRIC))
_PERIOD = _struct(TimePeriod=_struct(Start=STRING, End=STRING), Groups=T.ArrayType(_GROUP))
COST_FEED = _struct(
    tenant_id=STRING, aws_account_id=STRING, account_alias=STRING, ResultsByTime=T.ArrayType(_PERIOD)
)

ACTION_STEPS = "array<struct<step: int, details: string>>"

# The document an optimiser hands over for storage, before defaults are applied.
RECOMMENDATION_DOC = _struct(
    recommendation_type=STRING, title=STRING, description=STRING, priority=STRING,
    estimated_savings_monthly_usd=T.DecimalType(24, 2), confidence_score=T.DecimalType(3, 2),
    action_steps=T.ArrayType(_struct(step=T.IntegerType(), details=STRING)),
)

# The allowed entries of each enum-like text column.
DOMAINS = {
    "granularity": ["DAILY", "MONTHLY", "HOURLY"],
    "service_group": [
        "compute", "storage", "database", "network", "ai_ml", "analytics", "management", "other",
    ],
    "budget_period": ["monthly", "weekly", "daily"],
    "alert_type": ["budget_threshold", "spend_spike", "idle_resource", "forecast_breach"],
    "severity": ["info", "warning", "critical"],
    "alert_state": ["firing", "resolved", "acknowledged"],
    "anomaly_type": ["spend_spike", "new_service", "unusual_pattern", "regional_shift"],
    "forecast_method": ["linear", "exponential", "ml", "seasonal"],
    "recommendation_status": ["pending", "accepted", "rejected", "implemented", "archived"],
    "run_status": ["pending", "running", "success", "error", "timeout"],
    "resource_state": ["running", "stopped", "available", "idle", "unknown"],
}
