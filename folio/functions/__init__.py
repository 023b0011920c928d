"""Column functions: arithmetic, geometry, sizes, names and page rules."""
