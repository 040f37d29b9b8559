"""Column-level helpers: time arithmetic, coercion, lookups, stable hashes."""
