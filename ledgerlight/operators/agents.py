"""The log of agent runs: responses, token cost, cached results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fenced_json, sorted_json

TOKEN_COST = "decimal(18,6)"

# USD per million input and output tokens; the first match counts.
RATES = [("claude", "3.00", "15.00"), ("gpt-4o", "2.50", "10.00"), ("gpt-4", "30.00", "60.00")]
OTHER_RATE = ("0.50", "1.50")


def token_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of one run. The order of the rate card matters: gpt-4o also contains gpt-4."""

    def rate(index: int) -> Column:
        chain = F.when(model.contains(RATES[0][0]), F.lit(RATES[0][index + 1]))
        for r in RATES[1:]:
            chain = chain.when(model.contains(r[0]), F.lit(r[index + 1]))
        return chain.otherwise(F.lit(OTHER_RATE[index])).cast("decimal(6,2)")

    micro_usd = input_tokens * rate(0) + output_tokens * rate(1)
    return F.round(micro_usd / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast(TOKEN_COST)


def agent_run_costs(runs: DataFrame) -> DataFrame:
    return runs.withColumns(
        {
            "tokens_used": (F.col("input_tokens") + F.col("output_tokens")).cast("bigint"),
            "cost_usd": token_cost(F.col("api_model"), F.col("input_tokens"), F.col("output_tokens")),
        }
    )


def agent_spend(runs: DataFrame) -> DataFrame:
    """Token spend per tenant, agent, model and status."""
    return (
        agent_run_costs(runs)
        .groupBy("tenant_id", "agent_type", "api_model", "status")
        .agg(
            F.count("*").alias("runs"),
            F.sum("tokens_used").alias("tokens_used"),
            F.sum("cost_usd").cast("decimal(24,6)").alias("cost_usd"),
        )
    )


def fenced_json_extract(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """JSON of each response; a response that does not parse keeps its raw text."""
    body = fenced_json(F.col(text_col))
    parsed = F.try_parse_json(body)
    rows = responses.withColumns({"json_text": body, "parsed": F.to_json(parsed)})
    return rows.withColumns(
        {
            "success": F.col("parsed").isNotNull(),
            "raw_response": F.when(F.col("parsed").isNull(), F.col(text_col)),
        }
    )


def with_cache_key(entries: DataFrame, params_col: str = "params") -> DataFrame:
    """sha256 over the sorted-key JSON of the call parameters."""
    return entries.withColumn("cache_key", F.sha2(sorted_json(F.col(params_col)), 256))


def live_cache(entries: DataFrame, as_of_ts: Column) -> DataFrame:
    """Entries that have not expired."""
    return entries.where(F.col("expires_at") > as_of_ts)
