"""Column functions: text, colour, paths, keys."""
