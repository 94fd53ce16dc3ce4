"""Service name -> service group."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact, case-sensitive service names per group.
SERVICE_GROUPS = {
    "compute": [
        "Amazon EC2", "EC2 - Other", "AWS Lambda", "Amazon ECS", "Amazon EKS", "AWS Fargate",
        "Amazon Lightsail", "AWS Batch",
    ],
    "storage": [
        "Amazon S3", "Amazon Simple Storage Service", "Amazon EBS", "Amazon Elastic Block Store",
        "Amazon EFS", "Amazon S3 Glacier", "Amazon FSx", "AWS Storage Gateway",
    ],
    "database": [
        "Amazon RDS", "Amazon Relational Database Service", "Amazon DynamoDB",
        "Amazon ElastiCache", "Amazon Redshift", "Amazon Aurora", "Amazon DocumentDB",
        "Amazon Neptune", "Amazon MemoryDB",
    ],
    "network": [
        "Amazon CloudFront", "Amazon Route 53", "Amazon VPC", "Amazon API Gateway",
        "AWS Transit Gateway", "Amazon Global Accelerator", "AWS Direct Connect",
        "AWS PrivateLink",
    ],
    "ai_ml": [
        "Amazon SageMaker", "Amazon Bedrock", "Amazon Rekognition", "Amazon Comprehend",
        "Amazon Textract", "Amazon Polly", "Amazon Translate",
    ],
    "analytics": [
        "Amazon Athena", "Amazon EMR", "Amazon Kinesis", "AWS Glue", "Amazon QuickSight",
    ],
    "management": [
        "Amazon CloudWatch", "AWS CloudTrail", "AWS Config", "AWS Systems Manager",
        "AWS CloudFormation", "AWS CodeBuild", "AWS CodePipeline",
    ],
}

# Lower-case fragments tried in this order when no exact name matches.
NAME_FRAGMENTS = [
    ("compute", ["ec2", "lambda", "ecs", "eks", "fargate", "compute"]),
    ("storage", ["s3", "storage", "ebs", "efs", "glacier"]),
    ("database", ["rds", "dynamo", "database", "elasticache", "redshift"]),
    ("network", ["cloudfront", "route 53", "vpc", "api gateway", "network"]),
    ("ai_ml", ["sagemaker", "bedrock", "ai", "ml", "rekognition"]),
]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def service_group(column: str) -> Column:
    """Group of the service name in a column: exact name first, then fragments, else
    ``other``.

    One CASE of hash lookups and substring tests, so it stays inside codegen. Apply
    it after aggregating by service: the name is then tested once per group instead
    of once per usage line.
    """
    exact = [f"WHEN {column} IN ({_quoted(names)}) THEN '{group}'" for group, names in SERVICE_GROUPS.items()]
    fragments = [
        "WHEN " + " OR ".join(f"contains(lower({column}), '{f}')" for f in parts) + f" THEN '{group}'"
        for group, parts in NAME_FRAGMENTS
    ]
    return F.expr(f"CASE {' '.join(exact + fragments)} ELSE 'other' END")
