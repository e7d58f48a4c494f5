"""Structured Streaming ingest of pages and elements."""
