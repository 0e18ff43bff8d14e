"""Functions of the findings engine."""
