"""Column-level building blocks: NULL rules, keyed hashing, distribution functions."""
