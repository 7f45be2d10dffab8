"""Column expressions: no shuffles, no Python workers."""
