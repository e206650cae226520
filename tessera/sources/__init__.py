"""Readers: delimited files with dirty rows, and the JSON files that describe partitions."""
