"""Trip analytics on Spark: normalise, reconcile, aggregate, profile and chart ride records."""
