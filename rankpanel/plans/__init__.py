"""Registered queries: each key maps to a plan over the given tables and, where SQL can state it, the expected result."""

from . import registry  # noqa: F401
