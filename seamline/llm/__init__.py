"""Operators that prepare text and code collections as training data."""
