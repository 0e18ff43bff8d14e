"""Sources of the findings engine."""
