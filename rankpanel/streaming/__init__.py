"""Structured Streaming forms of the incremental and stateful work (ST-01..ST-08)."""
