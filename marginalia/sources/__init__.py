"""Readers and writers: JSON lines, Parquet tables, text, CSV, catalog tables and views."""
