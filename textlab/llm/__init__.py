"""Operators for training-data pipelines; nothing else in textlab imports this."""
