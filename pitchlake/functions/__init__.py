"""Column functions and small vectorized helpers."""
