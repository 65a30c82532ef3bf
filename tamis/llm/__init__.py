"""Operators of a training-data pipeline. Nothing else in tamis imports this package."""
