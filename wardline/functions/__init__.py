"""Column functions and SQL fragments."""
