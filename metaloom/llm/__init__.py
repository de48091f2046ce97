"""Operators for text and vectors of training data."""
