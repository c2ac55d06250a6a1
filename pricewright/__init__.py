"""Price analytics on Spark: feeds, linkage, percentiles, rule-based prices, reports."""
