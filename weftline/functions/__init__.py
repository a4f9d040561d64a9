"""Functions of the story engine."""
