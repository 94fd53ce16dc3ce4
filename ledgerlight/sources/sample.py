"""The given test tables seen as cost-model inputs.

Each function maps parquet tables of one scale-factor directory to an input of
the operators. Everything stays lazy; a date window applied by an operator is
pushed through the mapping down to the scan.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COST, MONEY
from . import feed

AS_OF = dt.date(2001, 9, 15)
PRIOR_AS_OF = dt.date(2001, 9, 8)
EVENTS_AS_OF = dt.date(2024, 1, 31)

# Fixed values of the mapping.
TENANTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SERVICES = [
    "Amazon EC2", "AWS Lambda", "Amazon S3", "Amazon RDS", "Amazon CloudFront", "Amazon SageMaker",
    "Amazon Athena", "Amazon CloudWatch", "Amazon Elastic Compute Cloud - Compute",
    "Amazon Elastic Container Service", "AmazonCloudWatch", "Amazon Virtual Private Cloud",
    "AWS Cost Explorer", "EC2 - Other", "Amazon DynamoDB", "AWS Glue",
]
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-south-1", "NoRegion", "global"]
ACCOUNTS = [f"{n:012}" for n in range(20)]  # four per tenant
RESOURCE_TYPES = ["ec2_instance", "rds_instance", "s3_bucket", "ebs_volume"]
BUDGET_FACTORS = ["0.40", "0.55", "1.00"]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from a footer once, not on every use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _list(values: list) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(values: list, index: str) -> Column:
    """The entry of a list at a position given as SQL text."""
    return F.expr(f"get({_list(values)}, cast({index} AS int))")


TENANT_IX = f"(cast(array_position({_list(TENANTS)}, {{0}}) AS int) - 1)"


def account_id(number: str) -> Column:
    return F.expr(f"lpad(cast({number} AS string), 12, '0')")


def account_alias(column: str = "aws_account_id") -> Column:
    """Accounts ending in 7 have no alias and show their id."""
    return F.expr(f"CASE WHEN endswith({column}, '7') THEN {column} ELSE concat('team-', {column}) END")


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    owner = orders.join(customer, F.expr("o_custkey = c_custkey"))
    joined = li.join(owner, F.expr("l_orderkey = o_orderkey")).join(supplier, F.expr("l_suppkey = s_suppkey"))
    free = "l_discount = 0.1D AND l_tax = 0"
    return joined.selectExpr(
        "c_mktsegment AS tenant_id",
        f"get({_list(ACCOUNTS)}, cast({TENANT_IX.format('c_mktsegment')} * 4 + l_orderkey % 4 AS int)) AS aws_account_id",
        "cast(l_shipdate AS date) AS date",
        f"get({_list(SERVICES)}, cast(l_partkey % 16 AS int)) AS service",
        f"get({_list(REGIONS)}, cast(s_nationkey % 6 AS int)) AS raw_region",
        """CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'Credit'
            WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN 'Refund' ELSE 'Usage' END AS record_type""",
        f"CASE WHEN {free} THEN 0D ELSE l_extendedprice * (1 - l_discount) / 100 END AS cost_usd",
        f"CASE WHEN {free} THEN 0D ELSE l_quantity END AS usage_quantity",
    )


def cost_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAILY cost records of the whole usage history."""
    return feed.to_daily_records(cost_rollup(spark, sf_dir), AS_OF)


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled-up usage with the alias of its account."""
    rollup = feed.usage_cells(usage_lines(spark, sf_dir))
    return rollup.withColumn("account_alias", account_alias())


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four accounts per tenant; some without alias."""
    tenants = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS tenant_id").distinct()
    first = TENANT_IX.format("tenant_id") + " * 4"
    return (
        tenants.selectExpr("tenant_id", f"explode(sequence({first}, {first} + 3)) AS n")
        .withColumn("aws_account_id", account_id("n"))
        .selectExpr(
            "tenant_id", "aws_account_id",
            "CASE WHEN endswith(aws_account_id, '7') THEN '' ELSE concat('team-', aws_account_id) END AS account_alias",
            "'pending' AS status",
            "cast(NULL AS timestamp_ntz) AS last_synced_at",
            "cast(NULL AS string) AS last_error",
            "date_add(DATE'2001-01-01', n * 3) AS created_at",
        )
    )


def budgets(spark: SparkSession, sf_dir: str, costs: DataFrame | None = None) -> DataFrame:
    """Budgets of all eight NULL patterns of (account, service group, region).

    Each limit is the August 2001 spend of its scope times a factor. Two literal
    rows per tenant add a zero limit and a scope without any spend.
    """
    costs = cost_records(spark, sf_dir) if costs is None else costs
    august = costs.where("date >= DATE'2001-08-01' AND date < DATE'2001-09-01'")
    factors = ", ".join(f"'{f}'" for f in BUDGET_FACTORS)
    cells = (
        august.groupBy("tenant_id", "aws_account_id", "service_group", "region")
        .agg(F.sum("cost_usd").alias("cost_usd"))
        .groupingSets(
            [["tenant_id", *extra] for extra in budget_patterns()],
            "tenant_id", "aws_account_id", "service_group", "region",
        )
        .agg(F.sum("cost_usd").alias("spend"))
        .selectExpr("*", f"explode(array({factors})) AS factor")
        .selectExpr(
            "tenant_id", "aws_account_id", "service_group", "region", "factor",
            f"cast(round(spend * cast(factor AS decimal(4,2)), 2) AS {MONEY}) AS limit_usd",
        )
    )
    extra = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS tenant_id").distinct().selectExpr(
        "tenant_id", "cast(NULL AS string) AS aws_account_id", "cast(NULL AS string) AS service_group",
        f"inline(array(struct('nowhere-1' AS region, '0.00' AS factor, cast(100 AS {MONEY}) AS limit_usd),"
        f" struct('us-east-1' AS region, '0.00' AS factor, cast(0 AS {MONEY}) AS limit_usd)))",
    )
    return (
        cells.unionByName(extra)
        .selectExpr(
            "*",
            """concat_ws('/', 'b', tenant_id, coalesce(aws_account_id, '*'), coalesce(service_group, '*'),
                coalesce(region, '*'), factor) AS id""",
        )
        .selectExpr("*", "sha2(id, 256) AS h")
        .selectExpr(
            "id", "tenant_id", "aws_account_id", "concat('Budget ', id) AS name", "service_group", "region", "limit_usd",
            "CASE WHEN substr(h, 2, 1) < '8' THEN 'monthly' WHEN substr(h, 2, 1) < 'c' THEN 'weekly' ELSE 'daily' END AS period",
            "80 AS alert_at_pct",
            "substr(h, 1, 1) >= '2' AS is_active",
            "date_add(DATE'2001-01-01', ascii(substr(h, 3, 1))) AS created_at",
        )
    )


def budget_patterns() -> list[list[str]]:
    """All subsets of the three optional scope columns."""
    out: list[list[str]] = [[]]
    for c in ("aws_account_id", "service_group", "region"):
        out += [p + [c] for p in out]
    return out


TENANT_OF_USER = f"get({_list(TENANTS)}, cast(floor((user_id % 20) / 4) AS int))"
ACCOUNT_OF_USER = f"get({_list(ACCOUNTS)}, cast(user_id % 20 AS int))"


def resource_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilisation samples of resources, one per event. Every eleventh resource is first
    seen on 20 January."""
    ev = table(spark, sf_dir, "events")
    return ev.where("NOT (user_id % 11 = 0 AND ts < timestamp_ntz'2024-01-20 00:00:00')").selectExpr(
        f"{TENANT_OF_USER} AS tenant_id",
        f"{ACCOUNT_OF_USER} AS aws_account_id",
        "concat('i-', user_id) AS resource_id",
        f"get({_list(RESOURCE_TYPES)}, cast(user_id % 4 AS int)) AS resource_type",
        "get(array('compute', 'database', 'storage', 'storage'), cast(user_id % 4 AS int)) AS service_group",
        f"get({_list(REGIONS[:4])}, cast(user_id % 3 AS int)) AS region",
        "concat('res-', user_id) AS name",
        "ts",
        "cast(round(value / 10, 6) AS decimal(12,6)) AS cpu_pct",
        "cast(least(round(value / 5, 6), 100D) AS decimal(12,6)) AS memory_pct",
        f"CASE WHEN user_id % 17 != 0 THEN cast(user_id * 1.25 AS {MONEY}) END AS monthly_cost_usd",
    )


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost lines with a tag document; every fifth line carries no tags."""
    return event_lines(table(spark, sf_dir, "events"))


def event_lines(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id",
        f"{TENANT_OF_USER} AS tenant_id",
        f"{ACCOUNT_OF_USER} AS aws_account_id",
        "event_type AS service",
        f"get({_list(REGIONS[:4])}, cast(user_id % 3 AS int)) AS region",
        "cast(ts AS date) AS date",
        "ts",
        f"cast(value AS {COST}) AS cost_usd",
        "CASE WHEN event_id % 5 = 0 THEN '{}' ELSE props END AS tags_json",
    )


def resource_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_changes(table(spark, sf_dir, "events"))


def event_changes(ev: DataFrame) -> DataFrame:
    """Sign-ups count as created, errors as terminated resources."""
    return ev.where("event_type IN ('signup', 'error')").selectExpr(
        "event_id AS change_id",
        f"{ACCOUNT_OF_USER} AS aws_account_id",
        "concat('i-', user_id) AS resource_id",
        "CASE WHEN event_type = 'signup' THEN 'created' ELSE 'terminated' END AS action",
        "ts AS changed_at",
    )


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ["claude-3-5-sonnet-20241022", "gpt-4o-mini", "gpt-4-turbo", "gpt-3.5-turbo"]
    agents = ["optimizer", "anomaly", "nlq", "forecaster", "reporter", "analyzer"]
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS run_no",
        f"{TENANT_OF_USER} AS tenant_id",
        f"get({_list(agents)}, cast(event_id % 6 AS int)) AS agent_type",
        f"get({_list(['scheduled', 'manual', 'webhook', 'event'])}, cast(event_id % 4 AS int)) AS trigger_type",
        f"get({_list(['success', 'success', 'error', 'pending', 'timeout'])}, cast(user_id % 5 AS int)) AS status",
        f"get({_list(models)}, cast(event_id % 4 AS int)) AS api_model",
        "cast(floor(value * 10) AS int) AS input_tokens",
        "cast(floor(value * 4) AS int) AS output_tokens",
        "props",
        "ts AS started_at",
    )


def agent_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response texts: fenced as json, fenced plain, bare, and broken JSON."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        r"""CASE event_id % 4 WHEN 0 THEN concat('Here:\n```json\n', props, '\n```')
            WHEN 1 THEN concat('```\n', props, '\n``` done')
            WHEN 2 THEN concat('  ', props, '\n') ELSE '```json\n{"k": \n' END AS response_text""",
    )


def ingestion_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = "o_custkey % 20"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id",
        f"get({_list(TENANTS)}, cast(floor(({account}) / 4) AS int)) AS tenant_id",
        f"lpad(cast({account} AS string), 12, '0') AS aws_account_id",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status",
        "cast(floor(o_totalprice / 100) AS int) AS records_pulled",
        """CASE WHEN o_orderstatus NOT IN ('F', 'O')
            THEN array(concat('Unexpected: ', o_orderpriority), 'retry later') END AS errors""",
        "o_orderdate AS started_at",
        """CASE WHEN o_orderstatus != 'O'
            THEN o_orderdate + make_dt_interval(0, 0, cast(o_custkey % 60 AS int)) END AS completed_at""",
    )


def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "map('service', event_type, 'account', cast(user_id AS string)) AS params",
        "ts + make_dt_interval(0, cast(event_id % 48 AS int)) AS expires_at",
    )
