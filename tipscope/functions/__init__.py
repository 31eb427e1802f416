"""Column-level expressions (features, text, vectors, safe statistics)."""
