"""Column expressions: special functions, measures, parsing of values."""
