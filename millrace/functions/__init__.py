"""Column functions: text, JSON, hashing, geometry and arrays."""
