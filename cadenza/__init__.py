"""Ordered interval data on Spark: timed text, the boxes beside it, and the runs that make it."""
