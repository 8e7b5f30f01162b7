"""Column -> Column building blocks (no I/O, no shuffles)."""
