"""Sources of the story engine."""
