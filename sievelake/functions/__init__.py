"""Column expressions: text cleaning, parsing, term matching and classification."""
