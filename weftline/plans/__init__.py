"""Plan helpers shared by operators."""
