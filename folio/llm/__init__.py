"""Operators a large-scale training-data pipeline needs. Nothing else in the package imports this folder."""
