"""Whole queries: the operators applied to the driver tables, and the same in SQL."""
