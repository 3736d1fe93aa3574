"""Column functions and the small Python helpers that run inside tasks."""
