"""Data-quality engine for event streams and tables, written for Spark."""
