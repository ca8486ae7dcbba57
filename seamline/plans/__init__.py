"""Whole plans: the engine and the registered queries."""
