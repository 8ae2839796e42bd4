"""Column functions: vectors as arrays of doubles, deterministic hash order."""
