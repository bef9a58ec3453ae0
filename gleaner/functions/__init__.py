"""Column expressions: vectors, text features, keys and hashing."""
