"""Column functions, lookup dimensions, and small per-value helpers."""
