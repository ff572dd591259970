"""Operators for large-scale training-data preparation, and their registered queries."""
