"""Column expressions: paths, time, notes, ids and settings."""
