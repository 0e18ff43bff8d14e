"""Sinks of the findings engine."""
