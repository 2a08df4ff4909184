"""Operators for large training-corpus pipelines."""
