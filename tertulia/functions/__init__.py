"""Column expressions: stateless, usable in batch and streaming plans."""
