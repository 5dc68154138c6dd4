"""Column-level functions: each takes Columns and returns Columns."""
