"""Column expressions: scalar labels, safe arithmetic and text functions."""
