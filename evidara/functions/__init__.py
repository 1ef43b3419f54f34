"""Column expressions: text, ordinals, hashes, validation. No Python UDFs."""
