"""Operators for training-data pipelines on text and on very large id columns."""
