"""Table-level trust operators."""
