"""Plans of the findings engine."""
