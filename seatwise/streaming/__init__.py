"""Structured Streaming versions of the alerts, boards and running totals."""
