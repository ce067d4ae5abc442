"""stroma: analytics over timestamped event tables as composable Spark DataFrame operators."""
