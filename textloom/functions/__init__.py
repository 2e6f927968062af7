"""Column expressions over text, spans and paths."""
