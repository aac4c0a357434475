"""Whole plans, the fixture they run on, and their DuckDB oracles."""
