"""Streaming of the property analytics engine."""
