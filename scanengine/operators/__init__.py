"""Operators over scans: each takes and returns DataFrames."""
