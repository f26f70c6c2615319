"""Column functions: permutations and scalar helpers."""
