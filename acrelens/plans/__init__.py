"""Plans of the property analytics engine."""
