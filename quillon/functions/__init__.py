"""Column expressions: three-valued labels, vectors, text and hashes."""
