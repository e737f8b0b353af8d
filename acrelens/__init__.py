"""Parcel-level property analytics as lazy PySpark plans."""
