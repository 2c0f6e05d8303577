"""Operators that a training-data pipeline needs, each usable on its own."""
