"""Column-to-column functions on text, boxes and markup."""
