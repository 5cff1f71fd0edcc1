"""Whole continuous queries, and the named queries that the driver checks."""
