"""Column functions and distributed statistics."""
