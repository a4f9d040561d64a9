"""Streaming of the story engine."""
