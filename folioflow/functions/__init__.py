"""Column functions: text, hashing, arithmetic, arrays and JSON."""
