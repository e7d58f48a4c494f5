"""Operators over document tables: layout geometry, tables, merging, metrics."""
