"""Column helpers that Spark has no single function for."""
