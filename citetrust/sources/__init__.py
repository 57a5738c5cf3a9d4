"""Readers and writers: XML dumps, Parquet and CSV artifacts."""
