"""Composable Spark operators for catalogue-and-review data."""
