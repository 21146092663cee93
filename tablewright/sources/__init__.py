"""Sources of the table engine."""
