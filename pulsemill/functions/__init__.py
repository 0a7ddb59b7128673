"""Column expressions: text normalisation, number hygiene, array arithmetic."""
