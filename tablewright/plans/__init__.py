"""Plans of the table engine."""
