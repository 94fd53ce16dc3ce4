"""ledgerlight: cloud-spend analytics as plain Spark DataFrame operators."""
