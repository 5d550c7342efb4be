"""Column expressions: text, numbers, dates and fingerprints."""
