"""Operators of the findings engine."""
