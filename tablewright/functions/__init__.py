"""Functions of the table engine."""
