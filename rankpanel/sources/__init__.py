"""Readers, side tables, panel stages and sinks."""
