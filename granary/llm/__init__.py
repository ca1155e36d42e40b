"""Operators of a training-data pipeline. Nothing else in granary imports this package."""
