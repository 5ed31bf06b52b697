"""Column-level helpers: time, JSON text, rounding, labels."""
