"""Column expressions: text, dates, numbers, status."""
