"""Column expressions: text hygiene, tokens, score scales and reproducible order."""
