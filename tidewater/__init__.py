"""A real-time warehouse on Spark: log and change-record ingestion, dimensions, fact tables and window summaries as DataFrame operators."""
