"""Column expressions: text, numbers, value encoding, evidence in text."""
