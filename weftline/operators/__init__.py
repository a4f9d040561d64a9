"""Operators of the story engine."""
