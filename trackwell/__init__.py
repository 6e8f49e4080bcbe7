"""trackwell: Spark-native processing of tracked items (records with status, dates, tags and sources)."""
