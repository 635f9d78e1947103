"""Column-expression building blocks (no Python UDFs): text, URLs, vectors, prompts, hashing."""
