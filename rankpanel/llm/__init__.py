"""Operators for training-data pipelines on document tables. Nothing else in the package imports this folder."""
