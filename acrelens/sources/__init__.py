"""Sources of the property analytics engine."""
