"""Readers, writers and the checkpoint folder."""
