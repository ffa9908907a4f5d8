"""Column expressions: paths, text, JSON, thumbnail keys."""
