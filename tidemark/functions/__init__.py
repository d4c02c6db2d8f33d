"""Scalar expressions that any engine can repeat bit for bit."""
