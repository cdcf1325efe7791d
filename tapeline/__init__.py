"""Market-event analytics on Spark: bars, dated events, as-of joins, patterns, settlement, statistics."""
