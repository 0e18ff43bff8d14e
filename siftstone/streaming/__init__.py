"""Streaming of the findings engine."""
