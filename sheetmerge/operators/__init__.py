"""Merge operators over DataFrames (no I/O, no collect)."""
