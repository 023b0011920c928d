"""Live operators: structured streams and their batch twins on the same step functions."""
