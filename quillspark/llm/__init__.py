"""Operators of a training-data pipeline; see README.md for the list."""
