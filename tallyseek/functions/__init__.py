"""Column expressions: text cleaning, calendar rules, vectors."""
