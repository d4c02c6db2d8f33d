"""Keyed, append-only operation logs and their summaries as Spark DataFrames."""
