"""Operators of the property analytics engine."""
