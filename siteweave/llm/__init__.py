"""Operators and the pipeline for training data.  Nothing outside this package imports it."""
