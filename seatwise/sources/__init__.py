"""Schemas, parquet sources and sinks, and the mapping of the test tables."""
