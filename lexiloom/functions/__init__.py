"""Column expressions: text cleaning, arrays, keyed hashing."""
