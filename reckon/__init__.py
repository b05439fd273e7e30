"""reckon: record reconciliation and tabular analytics as composable Spark DataFrame transformations."""
