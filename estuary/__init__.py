"""Event-study analytics on Spark: scans, as-of and window joins, masked panels, replay, statistics."""
