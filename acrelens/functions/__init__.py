"""Functions of the property analytics engine."""
