"""Column expressions: native Spark functions only, usable in batch and in streams."""
