"""Operators for preparing training data, and the pipeline's building blocks."""
