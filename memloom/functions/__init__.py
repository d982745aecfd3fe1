"""Column functions of the memory engine."""
